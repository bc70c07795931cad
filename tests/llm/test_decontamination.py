"""Cleaning by several blocks of benchmark items."""

from faultline.llm import decontamination


def test_blocks_do_not_change_cleaned_documents(spark):
    w = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    items = [(f"i{j}", w(f"q{j}x", 24)) for j in range(8)]
    free = lambda j, n: w(f"f{j}y", n)
    texts = [f"{free(0, 40)} {items[a][1]} {free(1, 20)} {items[b][1]}. End" for a in range(8) for b in range(8) if a != b]  # under half a document
    texts += [f"{free(2, 16)} {items[a][1]} {free(3, 16)} {items[b][1]}" for a in range(8) for b in range(8) if a != b]  # over half by two items alone
    # Words of one item that meet when another item between them is cut.
    halves = [(" ".join(t.split()[:12][:6]), " ".join(t.split()[6:14])) for _, t in items]
    texts += [f"{free(4, 60)} {halves[a][0]} {items[b][1]} {halves[a][1]} {free(5, 40)}" for a in range(8) for b in range(8) if a != b]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(None, None, "de"), (7, "", "fr")], "doc_id long, text string, lang string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert len(list(decontamination.automata(benchmark, 10, 100))) > 1
    clean = lambda n: sorted((str(r["doc_id"]), str(r["text"]), r["lang"]) for r in decontamination.clean_documents(docs, benchmark, block_words=n).collect())
    whole = clean(decontamination.BLOCK_WORDS)
    assert clean(100) == whole and 56 < len(whole) < len(texts)
    left = spark.createDataFrame(whole, "doc_id string, text string, lang string")
    assert decontamination.find(left, benchmark).filter("n_hit > 0").count() == 0
