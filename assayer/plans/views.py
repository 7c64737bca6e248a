"""The test tables as records, labels, predictions, partitions and logits; each view in DataFrame form and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("en", "fr", "de", "es", "it")
#: Length of the vectors, whose components stand for logits, and what spreads them.
CLASSES, SPREAD = 64, 20


class Views:
    """Views over one folder of tables. `it` is declared and never seen."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def records(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("input"), F.col("lang").alias("label"), F.col("source").alias("group_id"))

    @property
    def labels(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(LABELS)), "pos int, label string")

    @property
    def predictions(self) -> DataFrame:
        d = F.col("doc_id")
        status = F.when(d % 17 == 0, "abstain").when(d % 19 == 0, "error").otherwise("ok")
        label = F.when(status != "ok", F.lit(None)).when(d % 23 == 0, "xx").when(d % 5 == 0, "en").otherwise(F.col("lang"))
        key = F.when(d % 29 == 0, F.concat(F.lit("none"), d)).otherwise(d.cast("string"))  # an id that no record has
        return self.table("documents").select(key.alias("id"), status.alias("status"), label.alias("predicted_label"))

    @property
    def previous(self) -> DataFrame:
        label = F.when(F.col("doc_id") % 7 == 0, "de").otherwise(F.col("lang"))
        return self.table("documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("ok").alias("status"), label.alias("predicted_label"))

    @property
    def parts(self) -> DataFrame:
        r = F.col("line") % 10
        return self.records.withColumn("part", F.when(r <= 6, "train").when(r == 7, "validation").when(r == 8, "test").otherwise("evaluation"))

    @property
    def logits(self) -> DataFrame:
        whole = F.transform("embedding", lambda v: v.cast("double") * SPREAD)
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("gold"), whole.alias("logits"))


#: The same views in SQL; a query's oracle starts with the ones it names.
SQL = {
    "v_rec": "SELECT doc_id AS line, CAST(doc_id AS VARCHAR) AS id, text AS input, lang AS label, source AS group_id FROM documents",
    "v_lbl": "SELECT * FROM (VALUES (0,'en'),(1,'fr'),(2,'de'),(3,'es'),(4,'it')) t(pos, label)",
    "v_pred": """SELECT CASE WHEN doc_id % 29 = 0 THEN 'none' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id, CASE WHEN doc_id % 17 = 0 THEN 'abstain' WHEN doc_id % 19 = 0 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN 'xx' WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS predicted_label
        FROM documents""",
    "v_out": """SELECT r.id, r.label AS gold,
        CASE WHEN p.id IS NULL THEN 'error' WHEN p.status <> 'ok' THEN p.status WHEN l.label IS NULL THEN 'invalid' ELSE 'label' END AS kind,
        CASE WHEN p.status = 'ok' THEN l.label END AS label,
        CASE WHEN p.id IS NULL THEN 'missing_prediction' WHEN p.status = 'error' THEN 'reported' WHEN p.status = 'ok' AND l.label IS NULL THEN 'unknown_label' END AS reason
        FROM v_rec r LEFT JOIN v_pred p ON p.id = r.id LEFT JOIN v_lbl l ON l.label = p.predicted_label""",
    "v_part": "SELECT *, CASE WHEN line % 10 <= 6 THEN 'train' WHEN line % 10 = 7 THEN 'validation' WHEN line % 10 = 8 THEN 'test' ELSE 'evaluation' END AS part FROM v_rec",
    "v_cell": "SELECT gold, CASE kind WHEN 'label' THEN label WHEN 'invalid' THEN '<invalid>' WHEN 'abstain' THEN '<abstain>' ELSE '<error>' END AS predicted, count(*) AS n FROM v_out GROUP BY 1, 2",
    "v_metric": """SELECT l.pos, l.label, coalesce(s.support, 0)::BIGINT AS support, coalesce(p.predicted, 0)::BIGINT AS predicted, coalesce(s.tp, 0)::BIGINT AS tp
        FROM v_lbl l LEFT JOIN (SELECT gold, sum(n) AS support, sum(CASE WHEN gold = predicted THEN n ELSE 0 END) AS tp FROM v_cell GROUP BY gold) s ON s.gold = l.label
        LEFT JOIN (SELECT predicted AS label, sum(n) AS predicted FROM v_cell GROUP BY predicted) p ON p.label = l.label""",
    "v_pair": """SELECT o.id, coalesce(o.kind = 'label' AND o.label = o.gold, FALSE) AS candidate, coalesce((CASE WHEN d.doc_id % 7 = 0 THEN 'de' ELSE d.lang END) = d.lang, FALSE) AS baseline
        FROM v_out o JOIN documents d ON CAST(d.doc_id AS VARCHAR) = o.id""",
    "v_logit": f"SELECT vec_id AS id, CAST(label AS VARCHAR) AS gold, list_transform(embedding, lambda x: x::DOUBLE * {SPREAD}) AS logits FROM embeddings",
    "v_d": "SELECT id, gold, logits, list_transform(logits, lambda x: x - list_max(logits)) AS d, list_position(logits, list_max(logits)) AS top, CAST(gold AS INT) + 1 AS gold_pos FROM v_logit",
    "v_conf": "SELECT *, 1 / list_sum(list_transform(d, lambda x: exp(x))) AS conf, ln(list_sum(list_transform(d, lambda x: exp(x)))) - d[gold_pos] AS nll FROM v_d",
}
#: Views that a view is made of.
NEEDS = {"v_out": ["v_rec", "v_lbl", "v_pred"], "v_part": ["v_rec"], "v_cell": ["v_out"], "v_metric": ["v_cell"], "v_pair": ["v_out"], "v_d": ["v_logit"], "v_conf": ["v_d"]}


def sql(body: str, *views: str) -> str:
    """body after the views that it uses, each once, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in NEEDS.get(name, []):
            add(below)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    return (f"WITH {', '.join(f'{n} AS ({SQL[n]})' for n in order)} " if order else "") + body
