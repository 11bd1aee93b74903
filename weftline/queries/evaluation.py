"""Evaluation queries: answers, boxes, segmentation, captions, palettes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.fixed_values import ARTICLES, CONTRACTIONS, CURLY_CONTRACTIONS, NUMBER_WORDS, PUNCTUATION
from ..functions.text import extract_answer, normalise_answer, process_digits_articles, process_punctuation, smart_join
from ..functions.vectors import colour
from ..operators import meteor, metrics
from ..tables import table


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted answer and ten ground truths of every conversation turn, derived from its words."""
    words = F.split(F.lower("text"), " ")
    pick = lambda k: F.get("w", (F.lit(k) % F.size("w")).cast("int"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("role").alias("question_type"), "turn", words.alias("w"))
    truth = F.array(*[pick(F.lit(k) * (F.col("turn") % 2 + 1) % 3) for k in range(10)])
    return rows.select("question_id", "question_type", F.when(F.col("turn") % 3 == 0, "number").when(F.col("turn") % 3 == 1, "yes/no").otherwise("other").alias("answer_type"),
                       F.concat(F.lit('"It is the '), pick(F.lit(0)), F.lit(' of it."')).alias("answer"), truth.alias("answers"))


def vqa_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy overall, by question and by answer type."""
    return metrics.accuracy_by_facet(metrics.vqa_scores(answers(spark, sf_dir)), "question_type", "answer_type")


def vqa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vqa_scores(answers(spark, sf_dir)).select("question_id", F.round("score", 9).alias("score"))


def vizwiz_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second rule set: predictions always normalised, truths never."""
    return metrics.vizwiz_scores(answers(spark, sf_dir), CURLY_CONTRACTIONS).select("question_id", F.round("score", 9).alias("score"))


def answer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of answer normalisation on turns."""
    t = F.concat(F.col("text"), F.lit(" The Two dogs, dont 3.5 .5 5. (a-b) an"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", extract_answer(t).alias("extracted"), process_punctuation(t).alias("punctuated"), process_digits_articles(t).alias("articled"),
        smart_join(F.array(F.col("role"), F.lit("SAYS"))).alias("joined"),
    )


def unanswerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and F1 of quality labels scored by the last two digits of the document's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("s"))
    out = metrics.unanswerability(table(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "s", "doc_id")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A true and a predicted box of each line, in an image of 640 x 480."""
    q, p, s = F.col("l_quantity"), F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    truth = F.array(q * 4, s * 3.0, q * 4 + 100, s * 3.0 + 120)
    shift = (p % 7 * 6).cast("double")
    pred = boxes.box_to_text(boxes.rescale(q * 4 + shift, F.lit(640)), boxes.rescale(s * 3.0 + shift, F.lit(480)), boxes.rescale(q * 4 + 100 + shift, F.lit(640)), boxes.rescale(s * 3.0 + 120, F.lit(480)))
    text = F.when(p == 13, F.lit("no box")).otherwise(pred)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", truth.alias("gt_box"), text.alias("pred_box"), F.lit(640).alias("width"), F.lit(480).alias("height"))


def box_iou_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of boxes with an IoU of a half or more."""
    return metrics.grounding_accuracy(_boxes(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


def box_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as text, counted."""
    rows = _boxes(spark, sf_dir)
    b = boxes.text_to_box(F.col("pred_box"))
    return rows.where(boxes.is_sane(b)).groupBy("pred_box").agg(F.count("*").alias("n"), F.sum(boxes.area(b)).alias("area"))


def box_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative boxes, flipped, and cropped to a grown window."""
    b = tuple(F.get("gt_box", F.lit(k)) / (640.0 if k % 2 == 0 else 480.0) for k in range(4))
    x1, x2 = boxes.flip(b[0], b[2])
    c = boxes.crop(b, (F.lit(0.2), F.lit(0.2), F.lit(0.6), F.lit(0.6)))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.round(x1, 9).alias("x1"), F.round(x2, 9).alias("x2"), *[F.round(v, 9).alias(f"c{k}") for k, v in enumerate(c)])


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of every pair of boxes of an order (J13): an order is an image, with seven lines at most."""
    rows = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "gt_box")
    other = rows.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_partkey").alias("q"), F.col("gt_box").alias("b2"))
    box = lambda c: tuple(F.get(c, F.lit(k)) for k in range(4))
    return rows.join(other, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "m", "q", F.round(boxes.iou(box("gt_box"), box("b2")), 9).alias("iou"))


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    x = (F.col("p") % 300).cast("string")
    caption = F.concat(F.lit("a <ref>dog "), F.col("p").cast("string"), F.lit("</ref><box>("), x, F.lit(",20)(400,300)</box> and <ref>cat</ref><box>(1,2)("), x, F.lit(",4)</box><box>(5,6)(7,8)</box>."))
    return orders.select("l_orderkey", caption.alias("caption"))


def grounded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and boxes of grounded captions."""
    rows = _grounded(spark, sf_dir).select("l_orderkey", F.posexplode(boxes.grounded_objects(F.col("caption"))).alias("k", "o"))
    return rows.select("l_orderkey", F.col("k").cast("long").alias("k"), F.col("o.phrase").alias("phrase"), F.array_join(F.array_distinct("o.boxes"), ";").alias("boxes"))


def rescaled_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with their boxes in thousandths of the image (F16)."""
    return _grounded(spark, sf_dir).select("l_orderkey", boxes.rescale_caption(F.col("caption"), F.lit(640), F.lit(480)).alias("caption"))


def miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two-class rasters: true class quality + 1 (0 where toxic and bad), predicted toxic."""
    gt = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 0).otherwise(F.col("quality") + 1)
    pixels = table(spark, sf_dir, "labels").select(gt.alias("gt"), F.col("toxic").alias("pred"))
    return metrics.mean_iou(pixels, 2).withColumn("mIoU", F.round("mIoU", 9))


def bleu_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-1 to BLEU-4 of documents against two benchmark items each."""
    docs, refs = _captions(spark, sf_dir)
    out = metrics.bleu(docs, refs, "id", F.col("w"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _captions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of all documents and two benchmark items each."""
    words = lambda c: F.array_remove(F.split(F.lower(c), "[ \n]+"), "")
    n = table(spark, sf_dir, "benchmark").count()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words("text").alias("w"))
    items = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("w"))
    keyed = docs.select("id", F.explode(F.array(F.col("id") % n, (F.col("id") + 1) % n)).alias("item_id"))
    return docs, keyed.join(items, "item_id").select("id", F.col("item_id").alias("ref_id"), "w")


def cider_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF cosine of the same captions, orders one to four."""
    return metrics.cider(*_captions(spark, sf_dir), "id", F.col("w")).withColumn("cider", F.round("cider", 6))


def rouge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence of the same captions."""
    docs, refs = _captions(spark, sf_dir)
    pairs = docs.join(refs.withColumnRenamed("w", "ref"), "id")
    return metrics.rouge_l(pairs, "w", "ref").select("id", "ref_id", F.round("rouge_l", 6).alias("rouge_l"))


def meteor_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of an answer against the sentences of the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    sentences = F.filter(F.split("text", r"[.\n]"), lambda s: F.trim(s) != "")
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(sentences).alias("place", "sentence"))
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), sentences.alias("told"))
    pairs = answers.join(asked, ["conv_id", "turn"], "left").withColumn("key", F.struct("conv_id", "turn", "place"))
    return meteor.meteor(pairs, "key", "sentence", "told").select("key.*", "pairs", "equal", "chunks", "words", "told", F.round("score", 9).alias("score"))


#: Colours of the palette.
COLOURS = 150


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour of each size of part as a class of a palette."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("id")).distinct()
    return sizes.select("id", *[c.alias(n) for n, c in colour(F.col("id"), COLOURS).items()])


def coloured_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as colours; label 0 is skipped."""
    rows = table(spark, sf_dir, "embeddings").where("label > 0")
    return rows.select("vec_id", *[c.alias(n) for n, c in colour(F.col("label") - 1, COLOURS).items()])


def film_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of frame i in a strip of frames 128 high."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 128).alias("top"), (F.col("turn") * 128 + 128).alias("bottom"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    vqa_accuracy, vqa_scores, vizwiz_accuracy, answer_rules, unanswerable, box_iou_acc, box_format, box_flip, box_pairs, grounded_objects, rescaled_captions, miou, bleu_stats, cider_like, rouge_scores,
    palette, coloured_labels, meteor_sentences, film_frames,
)}

# --- the same in DuckDB's words ---------------------------------------------------------------------

_q = lambda s: "'" + s.replace("'", "''") + "'"


def _map(m: dict[str, str]) -> str:
    return f"MAP([{', '.join(map(_q, m))}], [{', '.join(map(_q, m.values()))}])"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _extract(x: str) -> str:
    out = _strip(f"replace({x}, '\"', '')")
    for end in ("chr(10)", "'.'", "','", "'!'"):
        out = f"split_part({out}, {end}, 1)"
    out = f"lower({out})"
    steps = [f"(SELECT {out} AS x)"]
    for start in ("is ", "are ", "a ", "an ", "the "):
        steps.append(f"(SELECT CASE WHEN contains(x, '{start}') THEN split_part(x, '{start}', 2) ELSE x END AS x FROM {{}})")
    for end in (" of", " or ", " and "):
        steps.append(f"(SELECT split_part(x, '{end}', 1) AS x FROM {{}})")
    sql = steps[0]
    for s in steps[1:]:
        sql = s.format(sql)
    return f"(SELECT {_strip('x')} FROM {sql})"


def _punct(x: str) -> str:
    sql = f"(SELECT {x} AS o, {x} AS x)"
    for p in PUNCTUATION:
        sql = f"(SELECT o, CASE WHEN contains(o, {_q(p + ' ')}) OR contains(o, {_q(' ' + p)}) OR regexp_matches(o, '[0-9],[0-9]') THEN replace(x, {_q(p)}, '') ELSE replace(x, {_q(p)}, ' ') END AS x FROM {sql})"
    return f"(SELECT replace(replace(regexp_replace(x, '\\.([0-9])', chr(1) || '\\1', 'g'), '.', ''), chr(1), '.') FROM {sql})"


def _articles(x: str, contractions: dict[str, str] = CONTRACTIONS) -> str:
    words = f"list_filter(regexp_split_to_array({_strip(f'lower({x})')}, '\\s+'), lambda w: w != '')"
    digits = f"list_transform({words}, lambda w: coalesce({_map(NUMBER_WORDS)}[w], w))"
    kept = f"list_filter({digits}, lambda w: w NOT IN ({', '.join(map(_q, ARTICLES))}))"
    return f"array_to_string(list_transform({kept}, lambda w: coalesce({_map(contractions)}[w], w)), ' ')"


def _clean(x: str) -> str:
    return _strip(f"translate({x}, chr(10) || chr(9), '  ')")


_ANSWERS = """answers AS (SELECT conv_id * 100 + turn AS question_id, role AS question_type, CASE turn % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'yes/no' ELSE 'other' END AS answer_type,
    '"It is the ' || w[1] || ' of it."' AS answer, list_transform(range(10), lambda k: w[(k * (turn % 2 + 1) % 3) % len(w) + 1]) AS truths FROM (SELECT *, string_split(lower(text), ' ') AS w FROM conversations))"""
_LOO = "(m * least(1.0::DOUBLE, greatest(m - 1, 0) / 3.0::DOUBLE) + (n - m) * least(1.0::DOUBLE, m / 3.0::DOUBLE)) / n"
_NORMAL = lambda x, c=CONTRACTIONS: _articles(_punct(x), c)
_SCORES = f"""{_ANSWERS},
long AS (SELECT question_id, unnest(truths) AS t FROM answers),
cleaned AS (SELECT question_id, {_clean('t')} AS t FROM long),
differ AS (SELECT question_id, count(DISTINCT t) > 1 AS d FROM cleaned GROUP BY 1),
said AS (SELECT question_id, CASE WHEN d THEN {_NORMAL('p')} ELSE p END AS p FROM (SELECT question_id, d, {_clean('e')} AS p FROM (SELECT question_id, d, {_extract('answer')} AS e FROM answers JOIN differ USING (question_id)))),
truth AS (SELECT question_id, CASE WHEN d THEN {_NORMAL('t')} ELSE t END AS t FROM cleaned JOIN differ USING (question_id)),
matched AS (SELECT question_id, count(*) FILTER (t = p) AS m, count(*) AS n FROM truth JOIN said USING (question_id) GROUP BY 1),
scores AS (SELECT question_id, question_type, answer_type, {_LOO} AS score FROM matched JOIN answers USING (question_id))"""
_BOXES = """boxes AS (SELECT *, CASE WHEN p = 13 THEN 'no box' ELSE printf('(%03d,%03d)(%03d,%03d)', CAST(trunc((q * 4 + sh) / 640 * 999) AS INT), CAST(trunc((s + sh) / 480 * 999) AS INT), CAST(trunc((q * 4 + 100 + sh) / 640 * 999) AS INT), CAST(trunc((s + 120) / 480 * 999) AS INT)) END AS pred_box
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_partkey % 100 AS p, (l_suppkey % 50) * 3.0::DOUBLE AS s, CAST(l_partkey % 100 % 7 * 6 AS DOUBLE) AS sh FROM lineitem)),
parsed AS (SELECT *, coalesce(TRY_CAST(regexp_extract(pred_box, '\\(([0-9]+),([0-9]+)\\)\\(([0-9]+),([0-9]+)\\)', 1) AS DOUBLE), 0) AS a1, coalesce(TRY_CAST(regexp_extract(pred_box, '\\(([0-9]+),([0-9]+)\\)\\(([0-9]+),([0-9]+)\\)', 2) AS DOUBLE), 0) AS a2,
    coalesce(TRY_CAST(regexp_extract(pred_box, '\\(([0-9]+),([0-9]+)\\)\\(([0-9]+),([0-9]+)\\)', 3) AS DOUBLE), 0) AS a3, coalesce(TRY_CAST(regexp_extract(pred_box, '\\(([0-9]+),([0-9]+)\\)\\(([0-9]+),([0-9]+)\\)', 4) AS DOUBLE), 0) AS a4 FROM boxes)"""
_GROUNDED = """g AS (SELECT l_orderkey, min(l_partkey) AS p, CAST(min(l_partkey) % 300 AS VARCHAR) AS x FROM lineitem GROUP BY 1)"""

ORACLE_SQL: dict[str, str] = {
    "vqa_scores": f"WITH {_SCORES} SELECT question_id, round(score, 9) AS score FROM scores",
    "vqa_accuracy": f"""WITH {_SCORES} SELECT CASE WHEN grouping(question_type) = 0 THEN 'question_type' WHEN grouping(answer_type) = 0 THEN 'answer_type' ELSE 'overall' END AS facet,
        coalesce(question_type, answer_type) AS value, round(100 * avg(score), 2) AS accuracy, count(*) AS n FROM scores GROUP BY GROUPING SETS ((), (question_type), (answer_type))""",
    "vizwiz_accuracy": f"""WITH {_ANSWERS}, said AS (SELECT question_id, {_NORMAL('c', CURLY_CONTRACTIONS)} AS p FROM (SELECT question_id, {_clean('e')} AS c FROM (SELECT question_id, {_extract('answer')} AS e FROM answers))),
        matched AS (SELECT question_id, count(*) FILTER (t = p) AS m, count(*) AS n FROM (SELECT question_id, unnest(truths) AS t FROM answers) JOIN said USING (question_id) GROUP BY 1)
        SELECT question_id, round({_LOO}, 9) AS score FROM matched""",
    "answer_rules": f"""WITH t AS (SELECT conv_id, turn, role, text || ' The Two dogs, dont 3.5 .5 5. (a-b) an' AS t FROM conversations)
        SELECT conv_id, turn, {_extract('t')} AS extracted, {_punct('t')} AS punctuated, {_articles('t')} AS articled, lower(role || ' SAYS') AS joined FROM t""",
    "unanswerable": """WITH x AS (SELECT 1 - quality AS y, 1.0 - n_chars % 100 / 100.0::DOUBLE AS s FROM labels JOIN documents USING (doc_id)),
        st AS (SELECT s, sum(y) AS tp, count(*) AS n FROM x GROUP BY s), c AS (SELECT *, sum(tp) OVER w AS tpc, sum(n) OVER w AS nc FROM st WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
        SELECT (SELECT round(sum(tp * tpc / nc) / sum(tp), 9) FROM c) AS average_precision, round(2.0 * count(*) FILTER (s > 0.5 AND y = 1) / (count(*) FILTER (s > 0.5) + sum(y)), 9) AS f1_score FROM x""",
    "box_iou_acc": f"""WITH {_BOXES}, i AS (SELECT a1 / 999 * 640 AS x1, a2 / 999 * 480 AS y1, a3 / 999 * 640 AS x2, a4 / 999 * 480 AS y2, q * 4 AS g1, s AS g2, q * 4 + 100 AS g3, s + 120 AS g4 FROM parsed),
        k AS (SELECT greatest(least(x2, g3) - greatest(x1, g1), 0) * greatest(least(y2, g4) - greatest(y1, g2), 0) AS inter, (x2 - x1) * (y2 - y1) + (g3 - g1) * (g4 - g2) AS areas FROM i)
        SELECT round(avg(CASE WHEN inter / (areas - inter) >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) AS n FROM k""",
    "box_format": f"WITH {_BOXES} SELECT pred_box, count(*) AS n, sum((a3 - a1) * (a4 - a2)) AS area FROM parsed WHERE a1 <= a3 AND a2 <= a4 GROUP BY 1",
    "box_flip": f"""WITH {_BOXES}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, q * 4 / 640 AS a, s / 480 AS b, (q * 4 + 100) / 640 AS c, (s + 120) / 480 AS d FROM boxes),
        w AS (SELECT *, least(0.2, a) AS u, least(0.2, b) AS v, greatest(0.6, c) - least(0.2, a) AS w, greatest(0.6, d) - least(0.2, b) AS h FROM r)
        SELECT l_orderkey, l_linenumber, l_partkey, round(1 - c, 9) AS x1, round(1 - a, 9) AS x2, round((a - u) / w, 9) AS c0, round((b - v) / h, 9) AS c1, round((c - u) / w, 9) AS c2, round((d - v) / h, 9) AS c3 FROM w""",
    "box_pairs": f"""WITH {_BOXES}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, q * 4 AS x1, s AS y1, q * 4 + 100 AS x2, s + 120 AS y2 FROM boxes),
        k AS (SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_linenumber AS m, b.l_partkey AS q, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS inter FROM r a JOIN r b USING (l_orderkey))
        SELECT l_orderkey, l_linenumber, l_partkey, m, q, round(inter / (24000.0 - inter), 9) AS iou FROM k""",
    "grounded_objects": f"""WITH {_GROUNDED} SELECT l_orderkey, CAST(0 AS BIGINT) AS k, 'dog ' || p AS phrase, '(' || x || ',20)(400,300)' AS boxes FROM g
        UNION ALL SELECT l_orderkey, 1, 'cat', '(1,2)(' || x || ',4);(5,6)(7,8)' FROM g""",
    "rescaled_captions": f"""WITH {_GROUNDED}, f AS (SELECT l_orderkey, p, CAST(trunc(CAST(x AS DOUBLE) / 640 * 999) AS INT) AS x FROM g)
        SELECT l_orderkey, 'a <ref>dog ' || p || printf('</ref><box>(%03d,%03d)(%03d,%03d)</box> and <ref>cat</ref><box>(%03d,%03d)(%03d,%03d)</box><box>(%03d,%03d)(%03d,%03d)</box>.', x, CAST(trunc(20 / 480.0 * 999) AS INT), CAST(trunc(400 / 640.0 * 999) AS INT), CAST(trunc(300 / 480.0 * 999) AS INT),
            CAST(trunc(1 / 640.0 * 999) AS INT), CAST(trunc(2 / 480.0 * 999) AS INT), x, CAST(trunc(4 / 480.0 * 999) AS INT), CAST(trunc(5 / 640.0 * 999) AS INT), CAST(trunc(6 / 480.0 * 999) AS INT), CAST(trunc(7 / 640.0 * 999) AS INT), CAST(trunc(8 / 480.0 * 999) AS INT)) AS caption FROM f""",
    "miou": """WITH x AS (SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 0 ELSE quality + 1 END AS g, toxic FROM labels), y AS (SELECT g, CASE WHEN g = 0 THEN 0 ELSE toxic + 1 END AS p FROM x)
        SELECT round(sum((SELECT count(*) FROM y WHERE g = c AND p = c) / ((SELECT count(*) FROM y WHERE g = c OR p = c) + 1e-10)) / 2, 9) AS "mIoU" FROM (VALUES (1), (2)) t(c)""",
    "bleu_stats": """WITH n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda w: w != '') AS w FROM documents),
        r AS (SELECT id, item_id, list_filter(regexp_split_to_array(lower(b.text), '[ \\n]+'), lambda w: w != '') AS w FROM d, n, benchmark b WHERE item_id IN (id % n, (id + 1) % n)),
        o AS (SELECT unnest([1, 2, 3, 4]) AS o),
        dg AS (SELECT id, o, array_to_string(w[i:i + o - 1], ' ') AS g, count(*) AS c FROM (SELECT id, o, w, unnest(range(1, len(w) - o + 2)) AS i FROM d, o) GROUP BY ALL),
        rg AS (SELECT id, o, g, max(c) AS c FROM (SELECT id, item_id, o, array_to_string(w[i:i + o - 1], ' ') AS g, count(*) AS c FROM (SELECT id, item_id, o, w, unnest(range(1, len(w) - o + 2)) AS i FROM r, o) GROUP BY ALL) GROUP BY ALL),
        p AS (SELECT dg.o, ln(sum(least(dg.c, coalesce(rg.c, 0))) / CAST(sum(dg.c) AS DOUBLE) + 1e-15) AS l FROM dg LEFT JOIN rg USING (id, o, g) GROUP BY dg.o),
        s AS (SELECT id, len(d.w) AS c, min({'a': abs(len(r.w) - len(d.w)), 'b': len(r.w)})['b'] AS rr FROM d JOIN r USING (id) GROUP BY id, len(d.w)),
        b AS (SELECT CASE WHEN sum(c) >= sum(rr) THEN 1.0::DOUBLE ELSE exp(1 - sum(rr) / CAST(sum(c) AS DOUBLE)) END AS bp FROM s)
        SELECT round(exp((SELECT avg(l) FROM p WHERE o <= 1)) * bp, 9) AS bleu_1, round(exp((SELECT avg(l) FROM p WHERE o <= 2)) * bp, 9) AS bleu_2, round(exp((SELECT avg(l) FROM p WHERE o <= 3)) * bp, 9) AS bleu_3, round(exp((SELECT avg(l) FROM p)) * bp, 9) AS bleu_4 FROM b""",
    "cider_like": """WITH n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda w: w != '') AS w FROM documents),
        r AS (SELECT id, item_id, list_filter(regexp_split_to_array(lower(b.text), '[ \\n]+'), lambda w: w != '') AS w FROM d, n, benchmark b WHERE item_id IN (id % n, (id + 1) % n)),
        o AS (SELECT unnest([1, 2, 3, 4]) AS o),
        dg AS (SELECT id, o, array_to_string(w[i:i + o - 1], ' ') AS g, count(*) AS c FROM (SELECT id, o, w, unnest(range(1, len(w) - o + 2)) AS i FROM d, o) GROUP BY ALL),
        rg AS (SELECT id, item_id, o, array_to_string(w[i:i + o - 1], ' ') AS g, count(*) AS c FROM (SELECT id, item_id, o, w, unnest(range(1, len(w) - o + 2)) AS i FROM r, o) GROUP BY ALL),
        a AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS a FROM r),
        df AS (SELECT o, g, ln(any_value(a) / count(DISTINCT id)) AS idf FROM rg, a GROUP BY o, g),
        dw AS (SELECT id, o, g, c * coalesce(idf, ln(a)) AS x FROM dg LEFT JOIN df USING (o, g), a), rw AS (SELECT id, item_id, o, g, c * coalesce(idf, ln(a)) AS x FROM rg LEFT JOIN df USING (o, g), a),
        dl AS (SELECT id, o, sqrt(sum(x * x)) AS l FROM dw GROUP BY ALL), rl AS (SELECT id, item_id, o, sqrt(sum(x * x)) AS l FROM rw GROUP BY ALL),
        dot AS (SELECT id, item_id, o, sum(dw.x * rw.x) AS s FROM dw JOIN rw USING (id, o, g) GROUP BY ALL)
        SELECT id, round(10 * avg(coalesce(s / nullif(dl.l * rl.l, 0), 0)), 6) AS cider FROM r CROSS JOIN o LEFT JOIN dot USING (id, item_id, o) LEFT JOIN dl USING (id, o) LEFT JOIN rl USING (id, item_id, o) GROUP BY id""",
    "palette": "SELECT DISTINCT CAST(p_size AS BIGINT) AS id, CAST(255 - p_size % 6 * 42 AS INT) AS b, CAST(255 - p_size // 6 % 6 * 42 AS INT) AS g, CAST(255 - p_size // 36 % 6 * 42 AS INT) AS r FROM part",
    "coloured_labels": "SELECT vec_id, CAST(255 - (label - 1) // 36 % 6 * 42 AS INT) AS r, CAST(255 - (label - 1) // 6 % 6 * 42 AS INT) AS g, CAST(255 - (label - 1) % 6 * 42 AS INT) AS b FROM embeddings WHERE label > 0",
    "film_frames": "SELECT conv_id, turn, turn * 128 AS top, turn * 128 + 128 AS bottom FROM conversations",
}
