"""Line dedup of passages of fewer lines than a run."""

from __future__ import annotations

from weftline.llm import line_dedup


def test_long_lines_and_short_documents(spark):
    w = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    long, half, other = w("l", 51), w("h", 30), w("o", 21)
    rows = [
        (1, f"a\n{long}\nb\nc"), (2, f"d\n{long}\ne\nf"),  # one line of 51 words
        (3, f"g g\n{half}\n{other}\ni"), (4, f"j\n{half}\n{other}\nk"),  # two lines of 51 together
        (5, f"m\n{half}\nn\no"), (6, "a\np\nb\nq"),  # short lines without their neighbours stay
        (7, "one line"), (8, "one line"), (9, "two\nlines"), (10, "two\n\nlines"), (11, "two"),  # short documents
        (12, f"{w('x', 50)}\nr\ns"), (13, f"{w('x', 50)}\nt\nu"),  # 50 are not more than 50
    ]
    windows = lambda c: {(i, k) for k in (1, 2, 3) for i in range(len(c) - k + 1) if k == 3 or sum(len(x.split()) for x in c[i : i + k]) > 50 or k == len(c)}
    seen, want = set(), {}
    for key, text in rows:
        lines = [x for x in text.split("\n") if x]
        gone = set()
        for i, k in sorted(windows(lines)):
            gone |= set(range(i, i + k)) if (run := tuple(lines[i : i + k])) in seen else set()
            seen.add(run)
        want[key] = [x for j, x in enumerate(lines) if j not in gone]
    got = {r.doc_id: [x for x in r.text.split("\n") if x] for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
    assert got[2] == ["d", "e", "f"] and got[4] == ["j", "k"] and got[8] == got[10] == [] and got[11] == ["two"] and len(got[13]) == 3


def test_fewer_fingerprints_than_lines(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = line_dedup.line_hashes(docs.select(F.struct(F.col("doc_id").alias("id"), F.md5("text").alias("text")).alias("doc"), "text"))
    found = line_dedup.fingerprints(lines, 3).groupBy("k").count().collect()
    assert {r.k for r in found} == {1, 2, 3} and sum(r["count"] for r in found) < lines.agg(F.sum(F.size("c"))).first()[0]


def test_runs_of_other_lengths(spark):
    """Windows of four lines, with short ones of up to three, against all windows."""
    import random

    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(n)) for n in (1, 2, 3, 20, 24, 28, 55)]
    rows = [(k, "\n".join(rng.choice(lines[: rng.choice([3, 6, 7])]) for _ in range(rng.randint(1, 9)))) for k in range(300)]
    seen, want = set(), {}
    for key, text in rows:
        own = text.split("\n")
        gone = set()
        for i in range(len(own)):
            for k in range(1, 5):
                if i + k <= len(own) and (k == 4 or sum(len(x.split()) for x in own[i : i + k]) > 50 or (k == len(own) and k < 4)):
                    gone |= set(range(i, i + k)) if (run := tuple(own[i : i + k])) in seen else set()
                    seen.add(run)
        want[key] = "\n".join(x for j, x in enumerate(own) if j not in gone)
    got = {r._row.doc_id: r.kept for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).select("_row", "kept").collect()}
    assert got == want
