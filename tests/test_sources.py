"""Source trees, parsers, manifests, sinks and streams."""

from pyspark.sql import functions as F

from corpusloom.operators import evaluation
from corpusloom.sources import repository, storage
from corpusloom.streaming import metrics

PY = '"""Module."""\nclass A:\n    """Doc."""\n    def m(self):\n        def inner():\n            pass\n\nasync def f():\n    pass\n'
JS = "/** Draws. */\nexport class Box {\n  size() { return 1; }\n}\nexport const area = (x) => {\n  return x;\n}\nfunction go() {}\n"


def test_tree(spark, tmp_path):
    for name, text in {"src/a.py": PY, "src/b.js": JS, "node_modules/x.js": JS, "empty.py": "  \n", "notes.txt": "n", "broken.py": "def (", "deep/a/b/c/d.go": "package p\nfunc (r T) Run() {\n}\n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "src/bad.py").write_bytes(b"x = '\xff\xfe'\n")
    files = repository.read_files(spark, str(tmp_path), "r").cache()
    paths = {r.file_path: r for r in files.collect()}
    assert "node_modules/x.js" not in paths and paths["src/bad.py"].content == "x = ''\n"
    chunks = {(r.file_path, r.chunk_type, r.symbol_name) for r in repository.chunk_files(files).collect()}
    assert {("src/a.py", "class", "A"), ("src/a.py", "method", "m"), ("src/a.py", "function", "inner"), ("src/a.py", "function", "f"), ("src/a.py", "file", None)} <= chunks
    assert {("src/b.js", "class", "Box"), ("src/b.js", "function", "area"), ("src/b.js", "function", "go"), ("deep/a/b/c/d.go", "function", "Run")} <= chunks
    assert [c for c in chunks if c[0] == "broken.py"] == [("broken.py", "file", None)] and not [c for c in chunks if c[0] == "empty.py"]
    symbols = repository.structures(files)
    docs = {(r.symbol_name): r.doc for r in symbols.collect()}
    assert docs["A"] == "Doc." and docs["Box"] == "Draws."
    assert repository.units(symbols, files).where("symbol_name = 'A'").count() == 1
    meta = repository.metadata(files).first()
    assert meta.languages["python"] == 4 and meta.languages["go"] == 1
    assert {r.folder for r in repository.folders(files).collect()} == {"src", "deep", "deep/a", "deep/a/b"}


def test_manifests(spark):
    rows = [("requirements.txt", "# c\nflask==1\nreact_thing>=2\n\n"), ("a/package.json", '{"dependencies": {"next": "1"}, "devDependencies": {"vue": "2"}}'), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nactix-web = "4"\n[other]\nq = 1\n'), ("go.mod", "module m\nrequire x v1\n"), ("setup.py", "x=1"), ("b/pyproject.toml", '[project.dependencies]\n"fastapi" = "1"\n[tool]\nz = 2\n'), ("z/package.json", "not json")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    got = {(r.manifest, r.dependency) for r in repository.dependencies(files).collect()}
    assert got == {("requirements.txt", "flask"), ("requirements.txt", "react_thing"), ("Cargo.toml", "actix-web"), ("go.mod", "require"), ("pyproject.toml", "fastapi")}
    named = {(r.name, r.framework) for r in repository.frameworks(repository.dependencies(files)).collect()}
    assert named == {("flask", "Flask"), ("react_thing", "React"), ("actix-web", "Actix"), ("fastapi", "FastAPI")}


def test_comments_above():
    found = repository._comments("// one\n//  two\n\nclass A {}\nlet x = 1; // aside\nclass B {}\n/**\n * Draws\n *\n * a box.\n */\n\nfunction go() {}\n/* plain */ const f = 1;\n//\nclass C {}")
    assert found == {3: "one\ntwo", 12: "Draws\na box."}
    assert repository._comments("/*" + "x*" * 50_000) == {} and repository._comments("// a\n" * 50_000)[50_000].count("a") == 50_000


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, repository_id string")
    storage.append_partitioned(rows, str(tmp_path / "t"), "repository_id")
    storage.append_partitioned(rows.where("id = 2"), str(tmp_path / "t"), "repository_id")
    assert spark.read.parquet(str(tmp_path / "t")).where("repository_id = 'b'").count() == 2
    assert [r.json for r in evaluation.snapshot_json(rows.where("id = 1")).collect()] == ['{"id":1,"repository_id":"a"}']
    assert [r.line for r in evaluation.markdown_table(rows.where("id = 1")).collect()] == ["| 1 | a |"]


def test_streams_equal_batch(spark, sf, tmp_path):
    batch = storage.load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, build, keys in (("w", lambda e: metrics.windowed_latency(e), ["w", "event_type"]), ("s", lambda e: metrics.sliding_error_ratio(e), ["w"]), ("u", lambda e: metrics.sessions(e), ["w", "user_id"])):
        out = str(tmp_path / name)
        metrics.run_available(build(metrics.event_stream(spark, sf)), out, str(tmp_path / f"{name}-state"))
        streamed = {tuple(map(str, (r[k] for k in keys))): r for r in spark.read.parquet(out).collect()}
        whole = {tuple(map(str, (r[k] for k in keys))): r for r in build(batch).collect()}
        # the last windows stay open behind the watermark
        assert streamed and all(tuple(v)[-1] == tuple(whole[k])[-1] for k, v in streamed.items())
        assert len(streamed) >= len(whole) * 0.9
