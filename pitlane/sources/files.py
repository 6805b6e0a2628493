"""Sources and sinks: CSV logs, columnar caches, JSON-lines ledgers, text logs, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.metrics import evaluate

LOG_SCHEMA = "user_id long, video_id int, date int, time_ms long, tab int, duration_ms double, long_view int"


def read_log(spark: SparkSession, paths: list[str], schema: str = LOG_SCHEMA) -> DataFrame:
    """CSV files with a header, one after the other, rows numbered by (file, line); a folder's files in the order of their names.

    All files are read at once. The rows of a block of a file are in the order of its lines; the sizes
    of the blocks, a row for each, make the offsets. A path that is given twice is an error.
    """
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    places = [(path_of(p).toUri().getRawPath().rstrip("/"), i) for i, p in enumerate(paths)]
    if len({p for p, _ in places}) < len(places):
        raise ValueError("a path is given twice")
    rows = spark.read.csv(paths, header=True, schema=schema).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    place = spark.createDataFrame(places, "path string, place int")
    file = F.regexp_replace("_f", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    blocks = rows.groupBy("_f", "_s").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")).withColumns({"_file": file, "_folder": F.regexp_replace(file, "/[^/]*$", "")})
    for name in ("_file", "_folder"):
        blocks = blocks.join(F.broadcast(place.select(F.col("path").alias(name), F.col("place").alias(f"{name}_place"))), name, "left")  # the paths that were given
    order = W.orderBy(F.coalesce("_file_place", "_folder_place"), "_f", "_s").rowsBetween(W.unboundedPreceding, -1)  # over blocks
    before = blocks.select("_f", "_s", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), ["_f", "_s"]).withColumn("row_id", F.col("_m") - F.col("_first") + F.col("_before")).drop("_f", "_s", "_m", "_first", "_before")


def parts(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder that a job wrote, in the order of their names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(str(f.getPath()) for f in found if not f.getPath().getName().startswith(("_", ".")))


def with_author(log: DataFrame, dimension: DataFrame, key: str, columns: list[str], missing: str = "UNK") -> DataFrame:
    """Left join by key; a miss, or a null attribute, becomes ``missing``."""
    return log.join(dimension.select(key, *columns), key, "left").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns})


def build_cache(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Parquet at ``path``, written unless it is there already; reading prunes columns."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_signal(spark: SparkSession, path: str, expected: int) -> DataFrame | None:
    """A materialised signal; None if there is none, an error if its rows aren't as many as expected."""
    if not _exists(spark, path):
        return None
    df = spark.read.parquet(path)
    if (n := df.count()) != expected:
        raise ValueError(f"{path} has {n} rows, expected {expected}")
    return df


LEDGER = "run string, iteration int, family string, decision string, valid double, seconds double, detail string"


def append_ledger(df: DataFrame, path: str, clip: int = 800) -> None:
    """Appends entries as JSON lines; details are clipped."""
    out = df.withColumn("detail", F.substring("detail", 1, clip)) if "detail" in df.columns else df
    out.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_errors(df: DataFrame, path: str, clip: int = 800) -> None:
    """Appends failures (iteration, kind, detail, recovery) as JSON lines, with the time; details are clipped."""
    df.select("iteration", "kind", F.substring(F.col("detail").cast("string"), 1, clip).alias("detail"), "recovery", F.date_format(F.current_timestamp(), "HH:mm:ss").alias("t")).write.mode("append").json(path)


class SealedSplit(RuntimeError):
    """Raised when a sealed split is asked for."""


AUDIT = "split string, call long, reason string, primary double"


def audited_score(df: DataFrame, label: str, score: str, split: str, path: str, reason: str = "", sealed: bool = False) -> DataFrame:
    """evaluate() of the scored rows of a split, after a line on it is appended to the audit log at ``path``.

    call counts the lines of this split. With ``sealed``, a test split is refused and no line is written; those of backtests aren't sealed.
    """
    if sealed and "test" in split and not split.startswith("backtest"):
        raise SealedSplit(f"{split} is sealed")
    spark = df.sparkSession
    result = evaluate(df.where(F.col("split") == split), label, score)
    r = result.first()
    calls = read_audit(spark, path).where(F.col("split") == split).count() if _exists(spark, path) else 0
    spark.createDataFrame([(split, calls + 1, reason, round(r.primary, 6))], AUDIT).write.mode("append").json(path)
    return spark.createDataFrame([r], result.schema)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A feature matrix (row_id and numbers) or predictions as Parquet, its columns' names and order in the schema."""
    matrix.write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, expected: int) -> tuple[DataFrame, list[str]]:
    """A stored matrix and the names of its columns in their order; an error unless it has ``expected`` rows."""
    df = read_signal(spark, path, expected)
    if df is None:
        raise FileNotFoundError(path)
    return df, [c for c in df.columns if c != "row_id"]


def run_report(ledger: DataFrame, errors: DataFrame, title: str) -> DataFrame:
    """run, iteration, part, line: a Markdown report of each run, in the order of the first three columns (iteration -1 is its head).

    Entries without a score say so; failures of an iteration follow it.
    """
    ok = F.col("valid").isNotNull() & ~F.isnan("valid")
    head = ledger.groupBy("run").agg(F.count("*").alias("n"), F.max(F.when(ok, F.col("valid"))).alias("best"), F.sum("seconds").alias("s"))
    lines = F.array(F.concat(F.lit(f"# {title} "), "run"), F.format_string("- Iterations: %d", "n"), F.format_string("- Wall-clock: %.0f s", "s"), F.coalesce(F.format_string("- Best primary: %.6f", "best"), F.lit("- Best primary: none")))
    out = head.select("run", F.lit(-1).alias("iteration"), F.posexplode(lines).alias("part", "line"))
    score = F.when(ok, F.format_string("| primary | %.6f |", "valid")).otherwise("No validation score.")
    entries = F.array(F.format_string("## Iteration %d: %s", "iteration", F.upper("decision")), F.concat(F.lit("Family: "), "family"), score)
    out = out.unionByName(ledger.select("run", "iteration", F.posexplode(entries).alias("part", "line")))
    failed = errors.select("run", "iteration", (F.lit(100) + F.row_number().over(W.partitionBy("run", "iteration").orderBy("kind", "detail"))).alias("part"), F.concat(F.lit("Error "), "kind", F.lit(": "), "detail", F.lit(" Recovery: "), "recovery").alias("line"))
    return out.unionByName(failed)


def parse_blocks(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """path, block: of each text file the JSON object behind the first ``"name":``, however nested and over however many lines; null if there is none or its braces don't close.

    A file is one row; logs of a run are small, and each is read by its own task.
    """
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    at = F.instr("value", F.lit(f'"{name}"'))
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '\"" + name + "\"'))"))
    start = F.locate("{", rest)
    body = F.when(start > 0, F.substring(rest, start, F.length(rest)))
    chars = F.split(body, "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s, c):
        quote = (c == '"') & ~s.escaped
        quoted = s.quoted != quote
        depth = s.depth + F.when(s.quoted | quote, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s.i + 1).alias("i"), F.when((s.end == 0) & (depth == 0) & ~quoted, s.i + 1).otherwise(s.end).alias("end"), quoted.alias("quoted"), (s.quoted & ~s.escaped & (c == "\\")).alias("escaped"))

    end = F.aggregate(chars, state, step, lambda s: s.end)
    return text.select("path", F.when(end > 0, F.substring(body, F.lit(1), end)).alias("block"))


def parse_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that say STOPPED or CONVERGED: status, reason; and metrics from a JSON block on the line."""
    status = F.regexp_extract(column, r"\b(STOPPED|CONVERGED)\b[: ]*([^{]*)", 1)
    block = F.regexp_extract(column, r"(\{.*\})", 1)
    out = lines.select(status.alias("status"), F.trim(F.regexp_extract(column, r"\b(STOPPED|CONVERGED)\b[: ]*([^{]*)", 2)).alias("reason"), F.get_json_object(block, "$.primary").cast("double").alias("primary"))
    return out.where("status <> '' or primary is not null")


def submission(df: DataFrame, score: str) -> DataFrame:
    """row_id, user_id, video_id, and the score as text of at most six significant digits, without zeros at the end of its fraction."""
    text = F.regexp_replace(F.format_string("%.6g", F.col(score)), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return df.select("row_id", "user_id", "video_id", F.regexp_replace(text, r"\.(e|$)", "$1").alias("score"))


def write_submission(df: DataFrame, score: str, path: str) -> None:
    """CSV in row order: range-partitioned files whose names sort as their rows do."""
    submission(df, score).orderBy("row_id").write.mode("overwrite").csv(path, header=True)


def submission_violations(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """rule, n of each rule: missing, extra and repeated rows, ids that don't match, scores that are no finite number."""
    s = submitted.groupBy("row_id").agg(F.count("*").alias("_n"), F.first("user_id").alias("_u"), F.first("video_id").alias("_v"), F.first("score").alias("_s"))
    e = expected.select("row_id", "user_id", "video_id", F.lit(1).alias("_e"))
    both = s.join(e, "row_id", "full_outer")
    number = F.expr("try_cast(_s as double)")
    rules = {
        "missing": F.col("_n").isNull(),
        "extra": F.col("_e").isNull(),
        "repeated": F.col("_n") > 1,
        "misaligned": F.col("_n").isNotNull() & F.col("_e").isNotNull() & ~((F.col("_u") == F.col("user_id")) & (F.col("_v") == F.col("video_id"))),
        "not_finite": F.col("_n").isNotNull() & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))),
    }
    one = both.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("x.*")


def tie_count(df: DataFrame, score: str, group: str = "user_id") -> DataFrame:
    """ties: rows whose score equals that of the row before them in their list."""
    before = F.lag(score).over(W.partitionBy(group).orderBy(score))
    return df.select((F.col(score) == before).alias("_t")).agg(F.count_if("_t").alias("ties"))
