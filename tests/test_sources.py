import gzip
from pathlib import Path

from pyspark.sql import functions as F

from docketry.sources import readers, writers
from docketry.streaming.upserts import keep_upserted


def test_csv_with_line_ends_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('n,t\n1,"x ""q""\ny"\n2,caf\xe9\n'.encode("latin-1"))
    rows = readers.csv(spark, str(tmp_path / "a.csv"), encoding="ISO-8859-1").collect()
    assert [r["t"] for r in rows] == ['x "q"\ny', "café"]


def test_grid_lookup_names_json(spark, tmp_path):
    (tmp_path / "g.csv").write_text("head,x,y\n,,\n2001,A & B,\n2002,C,D\n")
    assert [(r["year"], r["_c1"]) for r in readers.grid(spark, str(tmp_path / "g.csv"), 3).orderBy("year").collect()] == [(2001, "A & B"), (2002, "C")]
    (tmp_path / "l.txt").write_text("a ; x\nb;y\na;z\n\n")
    table = readers.lookup(spark, str(tmp_path / "l.txt"))
    assert {(r["key"], r["value"]) for r in table.collect()} == {("a", "z"), ("b", "y")}
    (tmp_path / "n.txt").write_text("Chile\nPeru\n")
    aliases = spark.createDataFrame([("Peru",), ("PE",)], "alias string")
    assert {r["name"] for r in readers.names(spark, str(tmp_path / "n.txt"), aliases).collect()} == {"Chile", "Peru", "PE"}
    (tmp_path / "m.json").write_text('{"a.pdf":\n "ATCM1"}')
    assert readers.json_map(spark, str(tmp_path / "m.json")).first()[:] == ("a.pdf", "ATCM1")


def test_text_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "r1.pdf.ocr.txt").write_text("one")
    (tmp_path / "sub" / "b.txt").write_bytes(b"bad\xffbyte")
    assert [(r["document"], r["text"]) for r in readers.texts(spark, str(tmp_path)).collect()] == [("r1.pdf", "one")]
    assert {r["text"] for r in readers.text_tree(spark, str(tmp_path)).collect()} == {"one", "badbyte"}
    assert readers.file_heads(spark, str(tmp_path)).count() == 2
    before = readers.manifest(spark, str(tmp_path)).first()
    (tmp_path / "c.txt").write_text("new")
    assert readers.manifest(spark, str(tmp_path)).first() != before


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(2001, "b", [0.5, 1 / 3]), (2000, "a", [1.0, 2.0])], "year int, country string, v array<double>")
    writers.indexed_csv(rows.drop("v"), str(tmp_path / "i"), ["year"])
    assert next(Path(tmp_path / "i").glob("part*")).read_text().splitlines()[1:] == ["0,2000,a", "1,2001,b"]
    writers.vectors_csv(rows.coalesce(1), str(tmp_path / "v"), "v", 3)
    assert "0.333" in gzip.decompress(next(Path(tmp_path / "v").glob("part*")).read_bytes()).decode()
    writers.by_window(rows.drop("v"), str(tmp_path / "w"), "year")
    assert (tmp_path / "w" / "year=2000").is_dir()
    writers.report(rows, str(tmp_path / "r"), F.format_string("%d %s", "year", "country"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()} == {"2001 b", "2000 a"}
    kept = str(tmp_path / "k")
    rows.drop("v").write.parquet(kept)
    writers.upserted(spark.createDataFrame([(2000, "z")], "year int, country string"), kept, ["year"])
    assert {tuple(r) for r in spark.read.parquet(kept).collect()} == {(2001, "b"), (2000, "z")}


def test_stream_upserts_match_a_batch(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts", "value")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keep_upserted(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"], "ts")
    query.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = spark.read.parquet(str(tmp_path / "out" / str(last)))
    assert got.count() == source.count() and got.exceptAll(source).count() == 0


def test_sqlite_npz_and_cache(spark, tmp_path):
    import sqlite3

    import numpy as np

    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (k INT, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"v{k}") for k in range(25)])
        db.execute("CREATE TABLE none (k INT)")
    rows = readers.sqlite(spark, str(tmp_path / "a.db"), "t", "k long, v string", rows_per_part=10)
    assert sorted(map(tuple, rows.collect())) == [(k, f"v{k}") for k in range(25)]
    assert readers.sqlite(spark, str(tmp_path / "a.db"), "none", "k long").count() == 0
    np.savez(tmp_path / "d.npz", d=np.eye(2))
    assert readers.directions(str(tmp_path / "d.npz"), "d").tolist() == [[1, 0], [0, 1]]
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert [readers.cached(spark, str(tmp_path / "c"), build).count() for _ in range(2)] == [3, 3] and made == [1]
    writers.json_lines(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
