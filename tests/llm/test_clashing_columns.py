"""Extra input columns whose names an operator uses inside or gives out."""

from corpusloom.llm import html_content, mixing, simhash, surrogates, toxicity

NAMES = ["n_entities", "copy", "order_key", "key", "u", "origin", "times", "tid", "pieces", "hit", "n", "_id", "_t", "c0", "c1", "score", "html_", "p", "a.b"]


def test_extra_columns_do_not_clash(spark):
    text = "write to ann.lee@mail.example.com, said Mr. Ivan Petrov, and many more words than that"
    rows = [(i, text if i < 3 else f"text {i} of its own", "s", *(f"{n}{i}" for n in NAMES)) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])
    held = lambda df: sorted((r["c0"], r["a.b"], r["_id"]) for r in df.collect())
    all_ = sorted((f"c0{i}", f"a.b{i}", f"_id{i}") for i in range(6))
    out = surrogates.replace(docs)
    assert held(out) == all_ and out.columns == [*(c for c in docs.columns if c != "n_entities"), "n_entities"]
    assert surrogates.replace(docs, count_column=None).columns == docs.columns
    mixed = mixing.mix(docs, extra=False)
    assert mixed.columns == docs.columns and set(held(mixed)) <= set(all_)
    assert mixing.mix(docs).columns[-2:] == ["copy", "order_key"]
    assert len(held(simhash.deduplicate(docs))) == 4 and simhash.deduplicate(docs).columns == docs.columns
    assert toxicity.score(docs, None).columns == [*(c for c in docs.columns if c != "score"), "score"]
    pages = html_content.extract(docs.withColumnRenamed("text", "html"))
    assert held(pages) == all_ and pages.columns[-2:] == ["text", "n_chars"]
