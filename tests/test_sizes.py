"""Work of a task does not grow with the table."""

from corpusloom.operators import rules
from corpusloom.plans import fixtures, symbols
from corpusloom.sources import storage


def _tasks(df):
    return df.rdd.getNumPartitions()


def test_lines_are_dealt_by_their_number(spark, sf, monkeypatch):
    rows = storage.load(spark, sf, "lineitem").count()
    want = sorted(map(tuple, rules.architecture_metrics(fixtures.code_lines(spark, sf)).collect()))
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    lines = fixtures.code_lines(spark, sf)
    assert _tasks(lines) == -(-rows // 500) > 4
    metrics = rules.architecture_metrics(lines)
    assert _tasks(metrics) == _tasks(lines)  # all windows and sums follow that deal
    assert _tasks(rules.performance_findings(lines)) == _tasks(lines)
    assert sorted(map(tuple, metrics.collect())) == want


def test_symbols_read_the_lines_once(spark, sf):
    ranges = symbols.symbol_ranges(fixtures.code_lines(spark, sf))
    assert "FileScan" not in ranges._jdf.queryExecution().executedPlan().toString()
    some = spark.createDataFrame([(1, 1, "class A:"), (1, 2, "    def f(self):"), (1, 3, "x"), (1, 4, "class B:"), (1, 5, "y"), (2, 1, "z")], "chunk_id long, line_no int, line string")
    assert sorted(map(tuple, symbols.symbol_ranges(some).collect())) == [(1, "class", 1, 3), (1, "class", 4, 5), (1, "function", 2, 3)]


def test_a_task_counts_words_in_steps():
    import pyarrow as pa

    from corpusloom.operators import inverted_index, retrieval

    words = [["a", "b", "a"], [], ["b"], None] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(["h"] * 800), pa.array(words, pa.list_(pa.string()))], names=["id", "digest", "words"])
    counted = list(retrieval._term_map(["a", "c", "b"])(iter([batch.select([0, 2])])))
    indexed = list(inverted_index._vector_map(iter([batch])))
    for parts in (counted, indexed):
        assert len(parts) == 4 and sum(p.num_rows for p in parts) == 800 and max(p.num_rows for p in parts) <= retrieval.STEP_ROWS
    rows = [r for p in counted for r in p.to_pylist()]
    assert [(r["id"], r["length"], dict(zip(r["term"], r["tf"]))) for r in rows[796:]] == [(796, 3, {0: 2, 2: 1}), (797, 0, {}), (798, 1, {2: 1}), (799, 0, {})]
    rows = [r for p in indexed for r in p.to_pylist()]
    assert [(r["length"], dict(zip(r["terms"], r["tfs"]))) for r in rows[796:]] == [(3, {"a": 2, "b": 1}), (0, {}), (1, {"b": 1}), (0, {})]


def test_a_segment_is_summed_where_its_blocks_meet():
    import pyarrow as pa
    from pyspark.sql import Row

    from corpusloom.operators import inverted_index

    asked = [Row(query_id=q, term=t, weight=w) for q, t, w in ((7, "a", 1.0), (7, "b", 2.0), (8, "b", 1.0))]
    names = ["segment", "term", "ids", "slots", "tfs", "lengths"]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    blocks = [(0, "a", [50, 51], [0, 1], [1, 1], [4, 4]), (0, "b", [51], [1], [1], [4]), (1 << 48, "b", [50], [0], [1], [4])]
    batches = [pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(b, kinds)], names=names) for b in blocks]
    run = inverted_index._score_map(asked, [7, 8], 4.0, {}, None)
    got = [tuple(r.values()) for batch in run(iter(batches)) for r in batch.to_pylist()]
    assert got == [(7, 0, 50, 1.0), (7, 0, 51, 3.0), (8, 0, 51, 1.0), (7, 1, 50, 2.0), (8, 1, 50, 1.0)]
    few = inverted_index._score_map(asked, [7, 8], 4.0, {7: 2.5}, {0: [7]})
    assert [tuple(r.values()) for batch in few(iter(batches)) for r in batch.to_pylist()] == [(7, 0, 51, 3.0)]


def test_duplicate_pairs_of_a_family(spark):
    """Copies of one text with words replaced, against all pairs; unlike ones do not leave the join."""
    import random

    from corpusloom.operators import similarity

    r = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(w if r.random() > (i % 10) / 25 else f"x{r.randrange(40)}" for w in base)) for i in range(150)]
    sets = {i: frozenset(t.split()) for i, t in rows}
    alike = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    seen = {}
    whole = similarity._shared_words

    def counted(pairs, *rest):
        seen["n"] = pairs.count()
        return whole(pairs, *rest)

    similarity._shared_words = counted
    try:
        got = set(map(tuple, similarity.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()))
    finally:
        similarity._shared_words = whole
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert got == {(a, b, j) for a, b, j in alike if first[sets[a]] == a and first[sets[b]] == b}
    assert len(got) > 100 and seen["n"] < 0.5 * 150 * 149 / 2


def test_duplicate_pairs_of_large_sets(spark, monkeypatch):
    """Unlike sets of many words end in the join; words meet in rounds; odd ids; no shuffle files are left."""
    import random

    from corpusloom.operators import similarity

    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2400)]
    base = [r.sample(vocabulary, r.choice((40, 800, 850, 1000))) for _ in range(50)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(w[r.randrange(len(w) // 5) :])) for i, w in enumerate(base[:25])]
    rows += [(200 + i, " ".join(reversed(w))) for i, w in enumerate(base[:5])] + [(3, "a b c"), (3, "a b c d"), (7, "a b c d e"), (None, rows[9][1] + " more"), (300, None), (301, "!")]
    heads = {}
    for i, text in rows:
        words = frozenset(w for w in (text or "").split() if w != "!")
        if words and i is not None:
            heads[words] = min(i, heads.get(words, i))
    want = sorted((heads[x], heads[y], round(len(x & y) / len(x | y), 6)) for x in heads for y in heads if heads[x] < heads[y] and 5 * len(x & y) >= 4 * len(x | y))
    seen, whole = {}, similarity._shared_words

    def counted(pairs, *rest):
        seen["n"], seen["key"] = pairs.count(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
        return whole(pairs, *rest)

    monkeypatch.setattr(similarity, "_shared_words", counted)
    monkeypatch.setattr(similarity, "WORDS_AT_ONCE", 3000)
    got = sorted(map(tuple, similarity.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()))
    assert got == want and (3, 7, 0.8) in got and len(got) > 20
    assert seen == {"n": seen["n"], "key": "true"} and seen["n"] < 2 * len(want)


def test_parity_bits_are_folded(spark):
    from corpusloom.operators import similarity

    rows = [([1, 2, 4, 8], [1, 2, 4, 8]), ([1, 2, 4, 8], [1, 0, 0, 8, 0, 2, 4, 0]), ([3, 0, 0, 0, 0, 0, 0, 7], [1, 0, 0, 7]), ([1] * 8, [0] * 8)]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>")
    assert [r[0] for r in df.select(similarity._differ(df.x, df.y)).collect()] == [0, 0, 1, 8]
