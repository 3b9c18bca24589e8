"""Readers of essay, pair and preference tables, with declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textprov.functions.text import null_words
from textprov.operators.rows import drop_if_present


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _INT, _NUMBER = T.StringType(), T.IntegerType(), T.DoubleType()

ESSAYS = _schema(id=_TEXT, text=_TEXT, generated=_INT, prompt_id=_INT)
HUMAN_ESSAYS = _schema(
    text=_TEXT,
    prompt_name=_TEXT,
    task=_TEXT,
    holistic_essay_score=_NUMBER,
    grade_level=_NUMBER,
    ell_status=_TEXT,
    student_disability_status=_TEXT,
)
PAIRS = _schema(human=_TEXT, ai=_TEXT)

# Quoted cells may hold line ends, commas and doubled quotes. The null mark is the
# one our writer uses; other spellings of null are taken out by ``null_words``.
CSV_READ = dict(
    header=True, multiLine=True, quote='"', escape='"', nullValue="\\N", emptyValue=""
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm_path.getFileSystem(conf).exists(jvm_path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of few, large pieces as many tasks as the session has cores.

    A small parquet file or a multi-line CSV file is one task, which would then do
    all the text work. A scan that already has enough tasks is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _read(df: DataFrame, field: T.StructField, words_are_null: bool) -> tuple[Column, Column]:
    """A column as it stands, null words apart, and as the type of ``field``."""
    given = F.col(field.name)
    if words_are_null and dict(df.dtypes)[field.name] == "string":
        given = null_words(given)
    if field.dataType == T.StringType():
        return given, given.cast("string")
    number = given.try_cast("double")
    if isinstance(field.dataType, T.IntegralType):
        number = F.when(number == F.floor(number), number)  # 0.7 is no label
    return given, number.try_cast(field.dataType)


def conform(df: DataFrame, schema: T.StructType, words_are_null: bool = True) -> DataFrame:
    """The columns of ``schema`` that ``df`` has, by name.

    What is no number becomes null, and so does a fraction where a whole number is asked
    for; ``unreadable`` counts them.
    """
    fields = [f for f in schema if f.name in df.columns]
    return df.select(*[_read(df, f, words_are_null)[1].alias(f.name) for f in fields])


def unreadable(df: DataFrame, schema: T.StructType, words_are_null: bool = True) -> DataFrame:
    """One row: for each column of ``schema`` that ``df`` has, how many values ``conform`` loses."""
    counts = []
    for field in schema:
        if field.name in df.columns:
            given, read = _read(df, field, words_are_null)
            counts.append(F.count_if(given.isNotNull() & read.isNull()).alias(field.name))
    return df.agg(*counts)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header."""
    return spark.read.options(**CSV_READ).csv(path)


def read_essays(
    spark: SparkSession, data_dir: str, name: str = "train_essays", fmt: str = "auto", strict: bool = False
) -> DataFrame:
    """Essays from ``{name}.csv``, or from ``{name}.parquet`` if there is no CSV.

    With ``strict``, values that cannot be read as their column's type are an error; it takes
    a pass more.
    """
    base = f"{data_dir.rstrip('/')}/{name}"
    if fmt == "auto":
        fmt = "csv" if path_exists(spark, f"{base}.csv") else "parquet"
    raw = read_csv(spark, f"{base}.csv") if fmt == "csv" else spark.read.parquet(f"{base}.parquet")
    if strict:
        lost = {c: n for c, n in unreadable(raw, ESSAYS, fmt == "csv").first().asDict().items() if n}
        if lost:
            raise ValueError(f"values that cannot be read, by column: {lost}")
    if fmt == "csv":
        return spread(conform(raw, ESSAYS), "id")
    return conform(raw, ESSAYS, words_are_null=False)


def read_split(spark: SparkSession, data_dir: str) -> DataFrame:
    """Train and valid parquet tables as one, told apart by ``fold``."""
    parts = [
        read_essays(spark, data_dir, f"{fold}_essays", "parquet").withColumn("fold", F.lit(fold))
        for fold in ("train", "valid")
    ]
    return parts[0].unionByName(parts[1])


def read_human_essays(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path).withColumnRenamed("full_text", "text")
    return conform(raw, HUMAN_ESSAYS)


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """``prompt, chosen, rejected``."""
    return drop_if_present(spark.read.parquet(path), "dpo_id", "diff")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return conform(read_csv(spark, path), PAIRS)
