"""box_pairs and box_flip over whole tables, against plain Python."""

from __future__ import annotations

from collections import Counter

from weftline.queries import evaluation


def test_every_order_and_part(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey").collect()
    per_order = Counter(r.l_orderkey for r in rows)
    pairs = evaluation.box_pairs(spark, sf_dir).collect()
    assert len(pairs) == sum(n * n for n in per_order.values())
    orders = {}
    for r in rows:
        x, y = 4 * r.l_quantity, r.l_suppkey % 50 * 3.0
        orders.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey, x, y))
    want = Counter()
    for k, boxes in orders.items():
        for a in boxes:
            for b in boxes:
                inter = max(100 - abs(a[2] - b[2]), 0) * max(120 - abs(a[3] - b[3]), 0)
                want[k, a[0], a[1], b[0], b[1], f"{inter / (24000 - inter):.6f}"] += 1
    assert Counter((r.l_orderkey, r.l_linenumber, r.l_partkey, r.m, r.q, f"{r.iou:.6f}") for r in pairs) == want
    flips = evaluation.box_flip(spark, sf_dir).collect()
    assert Counter((r.l_orderkey, r.l_linenumber, r.l_partkey, f"{r.x1:.6f}", f"{r.x2:.6f}") for r in flips) == Counter((r.l_orderkey, r.l_linenumber, r.l_partkey, f"{1 - (4 * r.l_quantity + 100) / 640:.6f}", f"{1 - 4 * r.l_quantity / 640:.6f}") for r in rows)
