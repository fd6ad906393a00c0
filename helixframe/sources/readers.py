"""Readers and writers of the domain's files; NaN becomes null, absent optional columns typed nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAF_COLUMNS = {"Hugo_Symbol": "string", "Variant_Classification": "string", "Variant_Type": "string", "Tumor_Sample_Barcode": "string", "HGVSp_Short": "string", "t_alt_count": "int", "t_ref_count": "int"}
DOSE_SCHEMA = "CELL_LINE_NAME string, COSMIC_ID long, DRUG_NAME string, DRUG_ID int, LN_IC50 double, AUC double, TCGA_DESC string"
PATIENT_SCHEMA = "patient_id string, cancer_type string, mutations array<struct<gene:string, variant:string, vaf:double>>, expression map<string,double>, cna map<string,double>, metadata map<string,string>"
EVIDENCE_SCHEMA = "id string, approvedSymbol string, tractability array<struct<label:string, value:boolean>>, associatedDiseases struct<rows:array<struct<score:double, disease:struct<name:string>>>>"
CIVIC_SCHEMA = "nodes array<struct<name:string, variants:struct<nodes:array<struct<name:string, evidenceItems:struct<nodes:array<struct<evidenceLevel:string, significance:string, therapies:array<struct<name:string>>>>>>>>>>"
TRIAL_SCHEMA = "protocolSection struct<identificationModule:struct<nctId:string, briefTitle:string>, statusModule:struct<overallStatus:string>, designModule:struct<phases:array<string>>, conditionsModule:struct<conditions:array<string>>, armsInterventionsModule:struct<interventions:array<struct<name:string>>>>"


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def select_known(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*((F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated variants; lines after # are comments; the known columns, others are dropped."""
    return select_known(spark.read.csv(path, sep="\t", header=True, comment="#"), MAF_COLUMNS)


def read_matrix(spark: SparkSession, path: str, row: str, column: str, value: str, sep: str = "\t") -> DataFrame:
    """A matrix whose first column names the rows, as (row, column, value)."""
    wide = spark.read.csv(path, sep=sep, header=True)
    first, *others = wide.columns
    return wide.select(F.col(first).alias(row), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in others)).unpivot([row], others, column, value)


def read_cna(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path, "gene", "sample_id", "score")


def read_methylation(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path, "probe", "sample_id", "beta")


def read_cohort(spark: SparkSession, data_path: str, labels_path: str, key: str = "sample_id") -> DataFrame:
    """Data joined with labels: columns called Unnamed... go; the label is ``Class`` if there is one, else the first."""
    drop = lambda df: df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")))
    data, labels = drop(spark.read.csv(data_path, header=True, inferSchema=True)), drop(spark.read.csv(labels_path, header=True, inferSchema=True))
    label = "Class" if "Class" in labels.columns else next(c for c in labels.columns if c != key)
    return data.join(labels.select(key, F.col(label).alias("label")), key)


def read_dose_response(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return nan_to_null(select_known(df, {f.split()[0]: f.split()[1] for f in DOSE_SCHEMA.split(", ")}))


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PATIENT_SCHEMA).json(path, multiLine=True)


class TableCache:
    """Tables kept by key under a root folder, as Parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        import hashlib

        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()[:16]}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def save(self, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(key))

    def load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self._path(key))

    def has(self, key: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._path(key) + "/_SUCCESS"))

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)


def pivot_values(rows: DataFrame, columns: list[str], row: str = "sample_id", column: str = "gene", value: str = "value", order: str = "ord") -> DataFrame:
    """A row per sample, a column per listed gene: its first value by ``order``, 0.0 if none."""
    return rows.groupBy(row).pivot(column, columns).agg(F.min_by(value, order)).fillna(0.0)


def pivot_clinical(rows: DataFrame, numeric: dict[str, str], text: dict[str, str], key: str = "patient_id") -> DataFrame:
    """Attribute rows (key, attribute, value) to columns: unreadable numbers are 0, a missing OS_STATUS is LIVING."""
    wide = rows.groupBy(key).pivot("attribute", [*numeric, *text]).agg(F.min("value"))
    default = lambda c: F.lit("LIVING") if c == "OS_STATUS" else F.lit(None).cast("string")
    return wide.select(key, *(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(n) for c, n in numeric.items()), *(F.coalesce(F.col(c), default(c)).alias(n) for c, n in text.items()))


def event_flag(status: Column) -> Column:
    """DECEASED, 1 or 1:... is 1; anything else 0."""
    return F.coalesce(F.upper(status.cast("string")).rlike("^1|DECEASED").cast("int"), F.lit(0))


def rename_mutations(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    have = {old: new for old, new in names.items() if old in rows.columns}
    return rows.select(*(F.col(old).alias(new) for old, new in have.items()))


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def fasta_sequence(record: Column) -> Column:
    """The record's letters A, C, G and T, without its header line."""
    return F.regexp_replace(F.upper(F.regexp_replace(record, "^>[^\n]*\n", "")), "[^ACGT]", "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(gene, seq) of each record of FASTA files: the first word of its header, and its letters."""
    record = F.regexp_replace("value", "^>", "")
    rows = spark.read.text(path, lineSep="\n>").where("value <> ''").select(record.alias("r"))
    return rows.select(F.regexp_extract("r", "^([^ \t\n]*)", 1).alias("gene"), fasta_sequence(F.concat(F.lit(">"), "r")).alias("seq"))


def flatten_targets(raw: DataFrame, column: str = "json") -> DataFrame:
    """Per disease row: target, disease, score, tractability labels, and the target's highest score (0 without any)."""
    rows = raw.select(F.from_json(column, EVIDENCE_SCHEMA).alias("t"))
    scores = F.coalesce(F.col("t.associatedDiseases.rows"), F.array().cast("array<struct<score:double,disease:struct<name:string>>>"))
    labels = F.map_from_entries(F.coalesce("t.tractability", F.array().cast("array<struct<label:string,value:boolean>>")))
    rows = rows.select(F.col("t.approvedSymbol").alias("gene"), labels.alias("tractability"), scores.alias("_rows"))
    # The highest score is a column of its own below the explosion: beside it, each disease's row would carry and search all.
    rows = rows.withColumn("overall", F.coalesce(F.array_max(F.transform("_rows", lambda r: r["score"])), F.lit(0.0)))
    rows = rows.select("gene", "overall", "tractability", F.explode_outer("_rows").alias("r"))
    return rows.select("gene", "overall", "tractability", F.col("r.disease.name").alias("disease"), F.col("r.score").alias("score"))


def flatten_civic(raw: DataFrame, column: str = "json") -> DataFrame:
    """Evidence items of the first gene node: (gene, variant, level, significance, therapies)."""
    rows = raw.select(F.get(F.from_json(column, CIVIC_SCHEMA)["nodes"], F.lit(0)).alias("g")).where("g IS NOT NULL")
    rows = rows.select(F.col("g.name").alias("gene"), F.explode("g.variants.nodes").alias("v")).select("gene", F.col("v.name").alias("variant"), F.explode("v.evidenceItems.nodes").alias("e"))
    return rows.select("gene", "variant", F.col("e.evidenceLevel").alias("level"), F.col("e.significance").alias("significance"), F.transform("e.therapies", lambda t: t["name"]).alias("therapies"))


def flatten_trials(raw: DataFrame, column: str = "json") -> DataFrame:
    p = F.from_json(column, TRIAL_SCHEMA)["protocolSection"]
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))
    return raw.select(
        text(p["identificationModule"]["nctId"]).alias("nct_id"), text(p["identificationModule"]["briefTitle"]).alias("title"), text(p["statusModule"]["overallStatus"]).alias("status"),
        F.coalesce(p["designModule"]["phases"], none).alias("phases"), F.coalesce(p["conditionsModule"]["conditions"], none).alias("conditions"),
        F.coalesce(F.transform(p["armsInterventionsModule"]["interventions"], lambda i: i["name"]), none).alias("interventions"),
    )


def evidence_score(genes: DataFrame, targets: DataFrame, civic: DataFrame, trials: DataFrame) -> DataFrame:
    """0.4 * target score + 0.3 * min(items / 10, 1) + 0.3 * min(trials / 10, 1); a source without the gene gives 0."""
    out = genes.join(targets, "gene", "left").join(civic, "gene", "left").join(trials, "gene", "left").fillna(0)
    part = lambda c: F.least(F.col(c) / 10, F.lit(1.0))
    return out.withColumn("evidence", F.round(0.4 * F.col("overall") + 0.3 * part("n_items") + 0.3 * part("n_trials"), 4))


