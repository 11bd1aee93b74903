"""Annotation algebra on orders, customers and documents: dedup, checked joins, facets, lookups, catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import dual_sort
from ..functions.hashing import hash01, hash01_sql
from ..operators import relational as rel
from ..operators import sampling as sam
from ..tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (source, lang), the first by id (A1)."""
    return rel.keep_first(_docs(spark, sf_dir), ["source", "lang"], ["doc_id"])


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (source, lang), the last by id (A2)."""
    return rel.keep_last(_docs(spark, sf_dir), ["source", "lang"], ["doc_id"])


def gather_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of four ranks in rank order, the first of each length kept."""
    ranked = sam.strided(_docs(spark, sf_dir), F.col("doc_id"), 4)
    return rel.keep_first(ranked, ["n_chars"], ["rank", "doc_id"]).select("n_chars", "rank", "doc_id")


def join_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, many to one, after the integrity checks."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return rel.checked_join(orders, customers, ["custkey"], one_to_one=False)


def join_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and questions by their key, unique on both sides."""
    docs = table(spark, sf_dir, "documents")
    return rel.checked_join(docs.select("doc_id", "lang"), docs.select("doc_id", "n_chars"), ["doc_id"])


def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels and labels without documents."""
    return rel.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def semi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is in the split of good labels."""
    return rel.in_split(_docs(spark, sf_dir), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with exactly four (P5)."""
    return rel.complete_groups(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 4)


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two types and a few users, any value (P10)."""
    return rel.facet_filter(table(spark, sf_dir, "events"), {"event_type": ["purchase", "signup"], "user_id": list(range(20)), "value": []}).select("event_id", "user_id", "event_type")


def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a list of ids in the list's order."""
    return rel.lookup(table(spark, sf_dir, "events").select("event_id", "event_type"), [7, 3, 99, 3], "event_id").select(F.col("pos").cast("long").alias("pos"), "event_id", "event_type")


def multimap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids of each user in order of time."""
    index = rel.multimap(table(spark, sf_dir, "events"), "user_id", "event_id", ["ts"])
    return index.select("user_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("event_ids"))


def followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first line and the lines after it as one ordered list."""
    lines = rel.multimap(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber"])
    held = lines.select("l_orderkey", F.get("values", F.lit(0)).alias("item"), F.slice("values", F.lit(2), F.size("values")).alias("following"))
    return rel.with_followers(held, "item", "following", "l_orderkey").select("l_orderkey", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct market segments with first place, count and inverse."""
    return rel.unique_counts(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"])


def size_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total size of listed shards; shards that the catalog lacks count zero."""
    sizes = sam.source_counts(_docs(spark, sf_dir), "source")
    listed = spark.createDataFrame([("src0",), ("src3",), ("src7",), ("missing",)], "source string")
    return listed.join(sizes, "source", "left").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("total"))


def nested_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as an array, those with enough quantity kept, and orders with two or more left."""
    arrays = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a"))
    kept = arrays.select("l_orderkey", F.filter("a", lambda x: x["l_quantity"] >= 25).alias("a")).where(F.size("a") >= 2)
    return kept.select("l_orderkey", F.size("a").cast("long").alias("n"), F.array_join(F.transform("a", lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


def thin_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by lines; half of those with a single line go by a hash of the key."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") > 1) | (hash01(1, F.col("l_orderkey")) > 0.5))


def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events a user at random, order of time restored."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    lists = sam.k_of_group(events, "user_id", "event_id", 3, 5).groupBy("user_id").agg(F.collect_list(F.struct("ts", "event_id")).alias("r"))
    order = dual_sort(F.transform("r", lambda x: x["ts"]), F.transform("r", lambda x: x["event_id"]))
    return lists.select("user_id", F.array_join(order.cast("array<string>"), ",").alias("event_ids"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from ids and ids from names and URLs."""
    pages = table(spark, sf_dir, "pages")
    name = F.format_string("COCO_val2014_%012d.jpg", F.col("page_id"))
    return pages.select(
        "page_id", name.alias("name"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("zfilled"),
        F.format_string("VizWiz_val_%08d.jpg", F.col("page_id")).alias("vizwiz"), F.regexp_extract(F.substring_index(name, "_", -1), "^([0-9]+)", 1).cast("long").alias("id_again"),
        F.substring_index("url", "/", -2).alias("last_two"),
    )


def limit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents in order."""
    return _docs(spark, sf_dir).orderBy("doc_id").limit(100)


def merged_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means merged from parts."""
    from ..operators.metrics import running_mean

    return running_mean(table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_linenumber").cast("double")), "l_returnflag", "l_discount", "n").select("l_returnflag", F.round("mean", 9).alias("mean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    dedup_first, dedup_last, gather_dedup, join_annotations, join_one_to_one, key_difference, semi_split, complete_groups, facet_filter, lookup_ids, multimap_index, followers,
    unique_values, size_catalog, nested_threshold, thin_singletons, cap_per_group, path_names, limit_prefix, merged_means,
)}

ORACLE_SQL: dict[str, str] = {
    "dedup_first": "SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1",
    "dedup_last": "SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1",
    "gather_dedup": "SELECT n_chars, doc_id % 4 AS rank, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY n_chars ORDER BY doc_id % 4, doc_id) = 1",
    "join_annotations": "SELECT o_custkey AS custkey, o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_one_to_one": "SELECT doc_id, a.lang, b.n_chars FROM documents a JOIN documents b USING (doc_id)",
    "key_difference": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_left, l.doc_id IS NOT NULL AS in_right FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "semi_split": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "complete_groups": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4)",
    "facet_filter": "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') AND user_id BETWEEN 0 AND 19",
    "lookup_ids": "SELECT CAST(pos AS BIGINT) AS pos, event_id, event_type FROM (VALUES (0, 7), (1, 3), (2, 99), (3, 3)) v(pos, id) JOIN events ON event_id = id",
    "multimap_index": "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS event_ids FROM events GROUP BY user_id",
    "followers": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS frames FROM lineitem GROUP BY l_orderkey",
    "unique_values": """WITH p AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
        SELECT c_mktsegment, min(pos) AS first_pos, count(*) AS n, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS inverse FROM p GROUP BY c_mktsegment""",
    "size_catalog": """SELECT CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM (VALUES ('src0'), ('src3'), ('src7'), ('missing')) v(source)
        LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) USING (source)""",
    "nested_threshold": "SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_quantity) AS lines FROM lineitem WHERE l_quantity >= 25 GROUP BY 1 HAVING count(*) >= 2",
    "thin_singletons": f"SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 OR {hash01_sql('1', 'l_orderkey')} > 0.5",
    "cap_per_group": f"""WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {hash01_sql('5', 'user_id', 'event_id')}, event_id) <= 3)
        SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts) AS event_ids FROM k GROUP BY 1""",
    "path_names": """SELECT page_id, 'COCO_val2014_' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '.jpg' AS name, lpad(CAST(page_id AS VARCHAR), 12, '0') AS zfilled,
        'VizWiz_val_' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.jpg' AS vizwiz, page_id AS id_again,
        list_aggregate(list_slice(string_split(url, '/'), -2, -1), 'string_agg', '/') AS last_two FROM pages""",
    "limit_prefix": "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "merged_means": "SELECT l_returnflag, round(sum(l_discount * l_linenumber) / sum(l_linenumber), 9) AS mean FROM lineitem GROUP BY 1",
}
