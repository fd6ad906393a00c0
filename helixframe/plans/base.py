"""Registration of queries, the standard tables, and views of them in the shapes of the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(v)``, where ``v`` gives tables and views; ``sql`` may use the views' names."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return register


#: SQL of each view; ``Views`` has the same in DataFrames.
VIEW_SQL = {
    "assay": "SELECT l_suppkey AS sample_id, concat('G', CAST(l_partkey % 40 AS VARCHAR)) AS gene, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2",
    "assay_a": "SELECT l_suppkey AS sample_id, concat('G', CAST(l_partkey % 40 AS VARCHAR)) AS gene, avg(l_extendedprice) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2",
    "assay_r": "SELECT l_suppkey AS sample_id, concat('G', CAST(l_partkey % 40 AS VARCHAR)) AS gene, avg(l_extendedprice) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "labels_s": "SELECT s_suppkey AS sample_id, r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "variants": "SELECT event_id AS ord, concat('G', CAST(event_id % 40 AS VARCHAR)) AS gene, CASE event_type WHEN 'purchase' THEN 'Missense_Mutation' WHEN 'error' THEN 'Nonsense_Mutation' WHEN 'view' THEN 'Silent' WHEN 'click' THEN 'Splice_Site' ELSE 'RNA' END AS variant_class, user_id AS sample_id, CAST(floor(value) AS INTEGER) AS t_alt_count, 100 AS t_ref_count FROM events",
    "clinical": "SELECT o_orderkey AS patient_id, o_orderpriority AS cancer_type, CAST(datediff('day', TIMESTAMP '1992-01-01', CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE) / 30.0 AS time, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, CAST(o_totalprice AS DOUBLE) AS expr, o_custkey % 7 AS grp FROM orders",
    "dose_response": "SELECT l_suppkey AS cell_line, p_brand AS drug, (CAST(l_quantity AS DOUBLE) - 25) / 8 AS ln_ic50, l_returnflag AS tissue FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cna": "SELECT concat('G', CAST(l_partkey % 40 AS VARCHAR)) AS gene, l_suppkey AS sample_id, max(CAST(l_quantity AS INTEGER) % 5 - 2) AS score FROM lineitem GROUP BY 1, 2",
    "methylation": "SELECT l_suppkey AS sample_id, concat('G', CAST(l_partkey % 40 AS VARCHAR)) AS probe, avg(l_discount) * 10 AS beta FROM lineitem GROUP BY 1, 2",
    "sequences": "SELECT concat('D', CAST(doc_id AS VARCHAR)) AS gene, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents",
    "proteins": "SELECT concat('D', CAST(doc_id AS VARCHAR)) AS gene, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACDEFGHIKLMNPQRSTVWYACDEFG') AS seq FROM documents",
    "drug_gene": "SELECT DISTINCT concat('drug', CAST(l_suppkey AS VARCHAR)) AS drug, p_brand AS gene FROM lineitem JOIN part ON l_partkey = p_partkey",
    "gene_pathway": "SELECT DISTINCT p_brand AS gene, p_type AS pathway FROM part",
    "predictions": "SELECT d.doc_id AS id, quality AS y, CAST(n_chars % 1000 AS DOUBLE) / 1000.0 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "member_proba": "SELECT id, m, k, w / sum(w) OVER (PARTITION BY id, m) AS p FROM (SELECT id, m, k, CAST((id * 7919 + m * 104729 + k * 31) % 1000 + 1 AS DOUBLE) AS w FROM (SELECT id FROM predictions), (SELECT unnest(range(10)) AS m), (SELECT unnest(range(3)) AS k))",
    "drug_dim": "SELECT min(p_partkey) AS ord, concat('G', CAST(p_partkey % 25 AS VARCHAR)) AS gene, p_brand AS drug, CASE WHEN min(p_size) % 4 = 0 THEN 'Approved' WHEN min(p_size) % 4 = 1 THEN 'Clinical trial' WHEN min(p_size) % 4 = 2 THEN 'Phase II' ELSE 'Approved (combination)' END AS status FROM part GROUP BY p_partkey % 25, p_brand",
    "pathway_dim": "SELECT min(p_partkey) AS ord, concat('G', CAST(p_partkey % 30 AS VARCHAR)) AS gene, concat('PW', CAST(p_size % 8 AS VARCHAR)) AS pathway FROM part GROUP BY p_partkey % 30, p_size % 8",
    "resistance_dim": "SELECT min(p_partkey) AS ord, concat('G', CAST(p_partkey % 20 AS VARCHAR)) AS gene, concat('M', CAST(p_size AS VARCHAR)) AS mechanism, min(p_brand) AS drug FROM part GROUP BY p_partkey % 20, p_size",
    "sl_dim": "SELECT min(p_partkey) AS ord, concat('G', CAST(p_partkey % 19 AS VARCHAR)) AS gene_a, concat('G', CAST(p_partkey % 17 + 20 AS VARCHAR)) AS gene_b FROM part GROUP BY p_partkey % 19, p_partkey % 17",
}


def with_views(sql: str) -> str:
    """Puts the views that the SQL names before it."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEW_SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(VIEW_SQL[name]) if name == "member_proba" else None
                need.append(name)

    add(sql)
    if not need:
        return sql
    head = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in sorted(need, key=list(VIEW_SQL).index))
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


class Views:
    """Tables of a folder, and the views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _assay(self, flag: str | None = None) -> DataFrame:
        rows = self.lineitem if flag is None else self.lineitem.where(F.col("l_returnflag") == flag)
        # Grouped by the gene's number: its name is made per group, not per row.
        means = rows.groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % 40).alias("_g")).agg(F.avg("l_extendedprice").cast("double").alias("value"))
        return means.select("sample_id", _gene(F.col("_g")).alias("gene"), "value")

    assay = property(lambda self: self._assay())
    assay_a = property(lambda self: self._assay("A"))
    assay_r = property(lambda self: self._assay("R"))

    @property
    def labels_s(self) -> DataFrame:
        nations = self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.supplier.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample_id"), F.col("r_name").alias("label"))

    @property
    def variants(self) -> DataFrame:
        kind = F.create_map(*(F.lit(x) for p in {"purchase": "Missense_Mutation", "error": "Nonsense_Mutation", "view": "Silent", "click": "Splice_Site"}.items() for x in p))
        return self.events.select(
            F.col("event_id").alias("ord"), _gene(F.col("event_id")).alias("gene"), F.coalesce(kind[F.col("event_type")], F.lit("RNA")).alias("variant_class"),
            F.col("user_id").alias("sample_id"), F.floor("value").cast("int").alias("t_alt_count"), F.lit(100).alias("t_ref_count"),
        )

    @property
    def clinical(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("patient_id"), F.col("o_orderpriority").alias("cancer_type"),
            (F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double") / 30.0).alias("time"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("event"), F.col("o_totalprice").cast("double").alias("expr"), (F.col("o_custkey") % 7).alias("grp"),
        )

    @property
    def dose_response(self) -> DataFrame:
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("cell_line"), F.col("p_brand").alias("drug"), ((F.col("l_quantity").cast("double") - 25) / 8).alias("ln_ic50"), F.col("l_returnflag").alias("tissue")
        )

    @property
    def cna(self) -> DataFrame:
        return self.lineitem.groupBy(_gene(F.col("l_partkey")).alias("gene"), F.col("l_suppkey").alias("sample_id")).agg(F.max(F.col("l_quantity").cast("int") % 5 - 2).alias("score"))

    @property
    def methylation(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_suppkey").alias("sample_id"), _gene(F.col("l_partkey")).alias("probe")).agg((F.avg("l_discount") * 10).cast("double").alias("beta"))

    def _letters(self, alphabet: str) -> DataFrame:
        letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", alphabet)
        return self.documents.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("gene"), letters.alias("seq"))

    sequences = property(lambda self: self._letters("ACGTACGTACGTACGTACGTACGTAC"))
    proteins = property(lambda self: self._letters("ACDEFGHIKLMNPQRSTVWYACDEFG"))

    @property
    def drug_gene(self) -> DataFrame:
        rows = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.concat(F.lit("drug"), F.col("l_suppkey").cast("string")).alias("drug"), F.col("p_brand").alias("gene")).distinct()

    @property
    def gene_pathway(self) -> DataFrame:
        return self.part.select(F.col("p_brand").alias("gene"), F.col("p_type").alias("pathway")).distinct()

    @property
    def predictions(self) -> DataFrame:
        return self.documents.join(self.labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("n_chars") % 1000).cast("double") / 1000.0).alias("p"))

    @property
    def member_proba(self) -> DataFrame:
        from pyspark.sql import Window as W

        each = self.predictions.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("m")).select("id", "m", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
        w = ((F.col("id") * 7919 + F.col("m") * 104729 + F.col("k") * 31) % 1000 + 1).cast("double")
        return each.withColumn("w", w).withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("id", "m"))).drop("w")

    @property
    def drug_dim(self) -> DataFrame:
        size = F.min("p_size") % 4
        status = F.when(size == 0, "Approved").when(size == 1, "Clinical trial").when(size == 2, "Phase II").otherwise("Approved (combination)")
        rows = self.part.groupBy(_gene(F.col("p_partkey"), 25).alias("gene"), F.col("p_brand").alias("drug"))
        return rows.agg(F.min("p_partkey").alias("ord"), status.alias("status")).select("ord", "gene", "drug", "status")

    @property
    def pathway_dim(self) -> DataFrame:
        rows = self.part.groupBy(_gene(F.col("p_partkey"), 30).alias("gene"), F.concat(F.lit("PW"), (F.col("p_size") % 8).cast("string")).alias("pathway"))
        return rows.agg(F.min("p_partkey").alias("ord")).select("ord", "gene", "pathway")

    @property
    def resistance_dim(self) -> DataFrame:
        rows = self.part.groupBy(_gene(F.col("p_partkey"), 20).alias("gene"), F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("mechanism"))
        return rows.agg(F.min("p_partkey").alias("ord"), F.min("p_brand").alias("drug")).select("ord", "gene", "mechanism", "drug")

    @property
    def sl_dim(self) -> DataFrame:
        rows = self.part.groupBy(_gene(F.col("p_partkey"), 19).alias("gene_a"), F.concat(F.lit("G"), (F.col("p_partkey") % 17 + 20).cast("string")).alias("gene_b"))
        return rows.agg(F.min("p_partkey").alias("ord")).select("ord", "gene_a", "gene_b")


def _gene(key, n: int = 40):
    return F.concat(F.lit("G"), (key % n).cast("string"))
