import hashlib

from oracle import connect, rows
from pyspark.sql import functions as F

from docketry.llm import line_dedup
from docketry.llm.queries import OP4_SQL, op4_line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(table, min_chars=40, min_docs=5):
    where = {}
    for i, text in table:
        for line in (text or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(k) >= min_chars:
                where.setdefault(k, set()).add(-(2**63) if i is None else i)
    hot = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for i, text in table:
        lines = (text or "").split("\n")
        keep = [x for x in lines if hot.get(x.strip(" \t\n\x0b\x0c\r").translate(LOWER), i) == (-(2**63) if i is None else i) or x.strip(" \t\n\x0b\x0c\r").translate(LOWER) not in hot]
        out.append((str(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def check(frame, **options):
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(frame, **options).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in frame.collect()], **options)


def test_equals_sql(spark, sf):
    assert rows(op4_line_dedup(spark, sf).toPandas()) == rows(connect(sf).execute(OP4_SQL).df())


def test_equals_brute_force(docs, odd, none):
    check(docs)
    check(odd, min_chars=1, min_docs=2)
    assert line_dedup.dedup_lines(none).count() == 0


def test_trimming_case_ties_and_repeats(spark):
    line = "Ünchanged Line Of More Than Forty Characters, Here"
    table = [(k, f"\t{line} \r\nx{k}\n{line.replace('Line', 'LINE')}") for k in range(6)] + [(5, "another row of five"), (None, line), (9, "\n\n")]
    check(spark.createDataFrame(table, "doc_id long, text string"))


def test_stage_keeps_documents(odd):
    out = line_dedup.without_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all(len(r["text"]) == r["n_chars"] for r in out.collect())


def test_hash_of_kept_text(spark, sf):
    r = op4_line_dedup(spark, sf).where("n_dropped = 0").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").first()
    assert r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_stage_keeps_columns_of_the_operator_s_names(odd):
    rows = line_dedup.without_repeated_lines(odd.withColumn("n_dropped", F.lit("n_dropped"))).collect()
    assert len(rows) == odd.count()
    assert {(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows} == {("n_lines", "n_dropped", "kept_text")}
