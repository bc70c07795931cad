"""Token alignment against a brute-force account of groups, links and counts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

from faultline.llm import token_alignment as T  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(T.BYTE_VOCABULARY), reason="vocabularies are not here")
SCHEMA = "doc_id long, text string, row long, pairs string, same int"


def tokens(text):
    """(id, bytes) on both sides by the libraries' plain calls."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return [], []
    a = Tokenizer.from_file(T.BYTE_VOCABULARY) if not hasattr(tokens, "a") else tokens.a
    b = sentencepiece.SentencePieceProcessor(model_file=T.PIECE_VOCABULARY) if not hasattr(tokens, "b") else tokens.b
    tokens.a, tokens.b = a, b
    a.encode_special_tokens = True
    letters = T._byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    whole = b"".join(x for _, x in left) == raw == b"".join(x for _, x in right)
    return (left, right) if whole else ([], [])


def groups(left, right):
    """Walk both sides; close a group wherever both ends meet."""
    out, i, j, end_a, end_b, own_a, own_b = [], 0, 0, 0, 0, [], []
    while i < len(left) or j < len(right):
        if end_a <= end_b:
            own_a.append(left[i][0])
            end_a += len(left[i][1])
            i += 1
        else:
            own_b.append(right[j][0])
            end_b += len(right[j][1])
            j += 1
        if end_a == end_b:
            out.append((own_a, own_b))
            own_a, own_b = [], []
    return out


def brute(docs):
    held = []
    for i, t in docs:
        left, right = tokens(t)
        found = groups(left, right)
        links = Counter((x, y) for a, b in found for x in a for y in b)
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found)
        held.append((i, len(left), len(right), len(found), links, hashlib.sha256(told.encode()).hexdigest() if found else ""))
    count = Counter(p for *_, links, _ in held for p in links)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter((i, a, b, g, sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in links.items()), digest) for i, a, b, g, links, digest in held)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    parts = ["the ", "running ", "Straße ", "naïve", " 12345 ", "\n\n", "  ", "xyzzy", "日本語", "🙂", "'s", "()", "aaaaaa", "<s>", "</s>", "<0x41>",
             "<|endoftext|>", "\t", "\x00", "é", "unbelievable "]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(60)]  # copies, so that some pairs are hot
    rows += [(3, rows[3][1]), (None, "the end"), (None, None), (300, None), (301, ""), (302, " "), (303, "a▁b"), (304, "the quick " * 5000),
             (305, "x" * 20_000), (306, " " * 5000), (307, "the end")]
    return rows


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_matches_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t, 5, "p", 1) for i, t in docs], SCHEMA).repartition(3)
    want = brute(docs)
    for hot in (T.HOT_PAIRS, 5, 0):
        assert found(T.align(df, hot_pairs=hot)) == want
    # Every text's own bytes hold, but for those that spell a blank by its stand-in.
    assert sum(n for x, n in want.items() if not x[1]) == 4


def test_empty_table_and_other_ids(spark):
    assert found(T.align(spark.createDataFrame([], SCHEMA))) == Counter()
    got = found(T.align(spark.createDataFrame([("a", "the end"), ("b", None)], "doc_id string, text string")))
    assert got == brute([("a", "the end"), ("b", None)])


def test_fast_and_plain_encoders_agree():
    side = T.ByteSide(T.BYTE_VOCABULARY)
    assert side.fast is not None
    for k in range(0, 0x3000):
        text = f"a{chr(k)}b {chr(k)} {chr(k)}1{chr(k)}2 's{chr(k)}{chr(k)}  {chr(k)}!"
        assert side.encode(text) == side.slow.encode(" " + text, add_special_tokens=False).ids
    for text in (" " * 1_000_000, "\n \n" * 300_000, "x" * 300_000, "!" * 300_000):
        assert side.encode(text) == side.slow.encode(" " + text, add_special_tokens=False).ids


def test_identity_map_holds_equal_bytes():
    tool = T.aligner(T.BYTE_VOCABULARY, T.PIECE_VOCABULARY)
    known = [(a, b) for a, b in enumerate(tool.identity.tolist()) if b >= 0]
    assert len(known) > 10_000 and all(tool.a.bytes[a] == tool.b.bytes[b] for a, b in known)


def test_long_blanks_are_found_by_few_characters():
    for n in (998, 999, 1000, 1001):
        for before in range(0, 200, 7):
            text = "a" * before + " \n\t" * (n // 3) + " " * (n % 3) + "b" * 50
            assert T._long_blank(text) == (n >= 1000)
    assert not T._long_blank("") and not T._long_blank(("a" * 99 + " ") * 100) and not T._long_blank((" " * 99 + "a") * 100)


def test_spelling_holds_tokens_against_bytes():
    spelt = T.Spelling([b"", b"a", b" b", b"\x00", "é".encode()])
    raw = lambda x: T.np.frombuffer(x, T.np.uint8)
    ids = lambda *x: T.np.array(x, T.np.int64)
    assert spelt.ends(ids(2, 1, 3, 4), raw(b" ba\x00\xc3\xa9")).tolist() == [2, 3, 4, 6]
    assert spelt.ends(ids(2, 1), raw(b" bb")) is None and spelt.ends(ids(2), raw(b" bb")) is None
    assert spelt.ends(ids(), raw(b" ")) is None and spelt.ends(ids(0), raw(b" ")) is None
