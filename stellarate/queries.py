"""The registered queries: every operator on the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellarate.functions import sampling, text
from stellarate.functions.numbers import binarize
from stellarate.operators import columns as cols
from stellarate.operators import distributions as dist
from stellarate.operators import evaluation, hashing, joins, sketches, states
from stellarate.operators import profile as prof
from stellarate.operators.encoding import (
    apply_categories,
    apply_scale,
    category_index,
    fit_categories,
    fit_scale,
    index_categories,
    min_max,
)
from stellarate.operators.tfidf import token_tfidf
from stellarate.plans import cleaning, exploration, training
from stellarate.session import scratch_path
from stellarate.sources import bucketed, variants
from stellarate.sources.tables import (
    Layout,
    parsed_lines,
    read_json,
    read_parquet,
    stored,
    whole_schema,
    write_json,
)

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
CONTRACTED = " I don't know; it's what I'm told, you've said we can't. Don't!"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Doubles rounded for comparison; with no names, all double columns."""
    chosen = names or [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: F.round(name, digits) for name in chosen})


# ---- scored labels: quality as the truth, "not toxic" as the prediction ----


def scored(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels")
    return joins.join_dimension(documents, labels, "doc_id").select(
        binarize(F.col("quality"), 0.5).alias("label"),
        (F.col("toxic") == 0).cast("double").alias("prediction"),
        F.col("n_chars").cast("double").alias("score"),
    )


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion_matrix(scored(spark, sf))


def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.class_metrics(scored(spark, sf)), 9)


def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.roc_points(scored(spark, sf), "score"), 9, "fpr", "tpr")


def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.area_under_roc(scored(spark, sf), "score"), 9)


def roc_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a curve of at most 50 points is within its bound of the exact area."""
    rows = scored(spark, sf)
    area = evaluation.curve_area(evaluation.bounded_curve(rows, "score", 50))
    exact = evaluation.area_under_roc(rows, "score").scalar()
    off = F.abs(F.col("bounded") - F.col("auc"))
    return area.withColumnRenamed("auc", "bounded").withColumn("auc", exact).select(
        (F.col("points") <= 50).alias("few_points"),
        (off <= F.col("slack") + 1e-12).alias("within"),
        (F.col("slack") < 0.02).alias("narrow"),
        F.round("auc", 9).alias("auc"),
    )


# ---- sources, sinks, columns ----


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    path = scratch_path(spark, "customer.json")
    write_json(customers, path)
    return read_json(spark, path, customers.schema)


def json_inferred(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "supplier.json")
    write_json(table(spark, sf, "supplier"), path)
    return read_json(spark, path).select(
        "s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal"
    )


def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return stored(table(spark, sf, "part"), scratch_path(spark, "part.parquet"))


def events_with_struct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn(
        "attributes", F.from_json("props", "k bigint")
    )


def struct_lift(spark: SparkSession, sf: str) -> DataFrame:
    lifted = cols.lift_fields(events_with_struct(spark, sf), {"event_k": "attributes.k"})
    return lifted.select("event_id", "attributes.k", "event_k")


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the type missing where it was ``error``."""
    return table(spark, sf, "events").withColumn(
        "event_type", F.nullif("event_type", F.lit("error"))
    )


def clean_dropna(spark: SparkSession, sf: str) -> DataFrame:
    rule = cleaning.Rule(drop=("props", "ts", "hours"), complete_rows_only=True)
    return cleaning.clean(gappy_events(spark, sf), rule)


def null_report(spark: SparkSession, sf: str) -> DataFrame:
    before = gappy_events(spark, sf)
    return cleaning.null_report(
        before, cleaning.clean(before, cleaning.Rule(complete_rows_only=True))
    )


def rename_join(spark: SparkSession, sf: str, broadcast_bytes: int = joins.BROADCAST_BYTES) -> DataFrame:
    lines = cols.rename(table(spark, sf, "lineitem"), {"l_partkey": "partkey"})
    lines = cols.drop_columns(lines, "l_shipdate", "l_suppkey", "l_tax", "l_comment")
    parts = cols.rename(
        table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"),
        {"p_partkey": "partkey", "p_retailprice": "part_price"},
    )
    joined = joins.join_dimension(
        lines, parts, "partkey", ["l_orderkey", "l_linenumber"], broadcast_bytes
    )
    return joined.withColumn("spent", F.col("l_quantity") * F.col("part_price"))


def bucketed_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their parts, from two tables in buckets: the join shuffles nothing."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("partkey"), "l_orderkey", "l_linenumber", "l_quantity"
    )
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), "p_brand", "p_retailprice")
    sides = [
        bucketed.write_bucketed(df, scratch_path(spark, name), "partkey", 8)
        for name, df in (("bucketed-lines", lines), ("bucketed-parts", parts))
    ]
    return bucketed.bucketed_join(spark, *sides)


def skewed_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the totals of their return flag: three keys, each with a large share."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    flags = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("flag_lines"), F.max("l_quantity").alias("flag_most")
    )
    return joins.join_dimension(
        lines, flags, "l_returnflag", ["l_orderkey", "l_linenumber"], 0, rows_per_part=5_000
    )


def rename_join_salted(spark: SparkSession, sf: str) -> DataFrame:
    """The same join on the way that big dimensions take."""
    return rename_join(spark, sf, broadcast_bytes=0)


def events_as_json(spark: SparkSession, sf: str) -> str:
    """Events as JSON lines with nested fields, every hundredth line broken; their path."""
    nested = table(spark, sf, "events").select(
        "event_id",
        "event_type",
        F.struct(
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            F.struct(F.col("user_id").alias("id"), F.col("value")).alias("user"),
        ).alias("attributes"),
    )
    line = F.to_json(F.struct("*"))
    broken = F.when(F.col("event_id") % 100 == 0, F.expr("substring(line, 1, 20)")).otherwise(
        F.col("line")
    )
    path = scratch_path(spark, "events.json")
    nested.withColumn("line", line).select(broken.alias("value")).write.text(path)
    return path


EVENT_COLUMNS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())]
)


def cleaning_job(spark: SparkSession, sf: str) -> DataFrame:
    """Landing JSON to cleaned Parquet and back: nested fields that no schema names stay."""
    path = events_as_json(spark, sf)
    rows, _ = parsed_lines(spark, path, whole_schema(spark, path, EVENT_COLUMNS))
    rule = cleaning.Rule(drop=("event_type",), complete_rows_only=True)
    cleaned = stored(cleaning.clean(rows, rule), scratch_path(spark, "cleaned.parquet"))
    return cleaned.select(
        "event_id",
        F.col("attributes.k").alias("k"),
        F.col("attributes.user.id").alias("user_id"),
        F.col("attributes.user.value").alias("value"),
    )


def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What the cleaning job could not read, by length of the line."""
    path = events_as_json(spark, sf)
    _, rejects = parsed_lines(spark, path, whole_schema(spark, path, EVENT_COLUMNS))
    kept = stored(rejects, scratch_path(spark, "rejected.parquet"))
    return kept.groupBy(F.length("line").alias("length")).agg(F.count(F.lit(1)).alias("lines"))


def odd_events(spark: SparkSession, sf: str) -> str:
    """``events_as_json`` with lines of other defects; their path.

    Of the ids that 89 divides a key stands twice, of 83 in two spellings, of 79 in capitals
    only, and of 73 something follows the object.
    """
    lines = spark.read.text(events_as_json(spark, sf))
    number = F.regexp_extract("value", r'"event_id":(\d+)', 1).cast("bigint")
    more = F.concat(F.regexp_replace("value", r"\}$", ""), F.lit(',"{}":1}}'))

    def added(key: str):
        return F.replace(more, F.lit("{}"), F.lit(key)).substr(F.lit(1), F.length(more) - 3 + len(key))

    line = (
        F.when(number % 89 == 0, added("event_id"))
        .when(number % 83 == 0, added("EVENT_ID"))
        .when(number % 79 == 0, F.regexp_replace("value", '"event_type"', '"EVENT_TYPE"'))
        .when(number % 73 == 0, F.concat("value", F.lit(" {}")))
        .otherwise(F.col("value"))
    )
    path = scratch_path(spark, "odd-events.json")
    lines.select(line.alias("value")).write.text(path)
    return path


def landing_variant(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a landing table whose lines have every sort of defect."""
    parsed = scratch_path(spark, "variants.parquet")
    rows, _ = variants.variant_lines(spark, odd_events(spark, sf), EVENT_COLUMNS, parsed)
    return rows.select(
        "event_id",
        "event_type",
        F.col("attributes.k").alias("k"),
        F.col("attributes.user.id").alias("user_id"),
        F.col("attributes.user.value").alias("value"),
    )


def variant_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the same table that are no rows, by the id that stands in them."""
    parsed = scratch_path(spark, "variants.parquet")
    _, rejects = variants.variant_lines(spark, odd_events(spark, sf), EVENT_COLUMNS, parsed)
    number = F.regexp_extract("line", r'"event_id":(\d+)', 1).cast("bigint")
    return rejects.groupBy(number.alias("event_id")).agg(F.count(F.lit(1)).alias("lines"))


def schema_listing(spark: SparkSession, sf: str) -> DataFrame:
    return cols.schema_profile(table(spark, sf, "lineitem"))


def typed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """First and last order date, from dates written as text."""
    written = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 10 == 0, "no date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("date")
    )
    dated = cleaning.typed_dates(written, "date")
    return dated.agg(
        F.min("date").cast("string").alias("oldest"),
        F.max("date").cast("string").alias("newest"),
        F.count_if(F.col("date").isNull()).alias("undated"),
    )


# ---- profiles ----


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents; quality and toxic are null where there is no label."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prof.null_counts(labelled_documents(spark, sf))


def nonnull_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prof.nonnull_counts(labelled_documents(spark, sf))


def null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return prof.null_rows(labelled_documents(spark, sf))


def null_columns(spark: SparkSession, sf: str) -> DataFrame:
    return prof.null_columns(labelled_documents(spark, sf))


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prof.row_count(table(spark, sf, "lineitem"))


def dup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return prof.duplicate_rows(table(spark, sf, "documents").drop("doc_id"))


def dup_rows_events(spark: SparkSession, sf: str) -> DataFrame:
    """Two copies of the events, one a microsecond later for two thirds of them."""
    events = table(spark, sf, "events").drop("event_id")
    later = F.when(F.col("user_id") % 3 != 0, F.expr("ts + INTERVAL 1 MICROSECOND"))
    moved = events.withColumn("ts", F.coalesce(later, F.col("ts")))
    return prof.duplicate_rows(events.unionByName(moved))


def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prof.describe_numeric(table(spark, sf, "events")), 4)


def describe_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prof.describe_all(table(spark, sf, "orders")), 4)


def summary_subset(spark: SparkSession, sf: str) -> DataFrame:
    chosen = ["o_totalprice", "o_orderpriority"]
    stats = ["count", "min", "max", "mean"]
    return rounded(prof.summary(table(spark, sf, "orders"), chosen, stats), 4)


def summary_approx(spark: SparkSession, sf: str) -> DataFrame:
    return prof.summary_all(table(spark, sf, "orders"))


def sketch_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """Whether quartiles of stored sketches, by priority and merged, are within the rank bound."""
    orders = table(spark, sf, "orders")
    numbers, by = ["o_custkey", "o_totalprice"], ["o_orderpriority"]
    kept = stored(sketches.quantile_sketches(orders, numbers, by), scratch_path(spark, "sketches.parquet"))
    whole = sketches.merged_sketches(kept)
    bound = sketches.rank_error()
    by_part = sketches.rank_errors(sketches.sketch_quantiles(kept, by), orders, by)
    total = sketches.rank_errors(sketches.sketch_quantiles(whole), orders)
    total = total.withColumn("o_orderpriority", F.lit("(all)"))
    counts = kept.select(*by, "column", "n").unionByName(
        whole.select(F.lit("(all)").alias("o_orderpriority"), "column", "n")
    )
    checked = by_part.unionByName(total).join(counts, [*by, "column"])
    return checked.select(*by, "column", "stat", "n", (F.col("error") <= bound).alias("within"))


def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prof.profile(table(spark, sf, "part"), "part"), 4)


def landed_states(df: DataFrame, key: str, parts: Sequence[str]) -> states.States:
    """States of a table that lands in four files, the last of them later than the others."""
    path = scratch_path(df.sparkSession, "states")
    file = F.concat(F.lit("part-"), F.pmod(F.xxhash64(key), F.lit(4)))
    landed = df.withColumn("file", file)
    for load in (F.col("file") != "part-3", F.col("file") == "part-3"):
        states.add_states(states.file_states(landed.where(load), "file"), path, parts)
    return states.kept_states(df.sparkSession, path, parts)


def profile_states(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of ``profile_table``, from the states of its files."""
    kept = landed_states(table(spark, sf, "part"), "p_partkey", states.PARTS)
    return rounded(states.merged_profile(kept, "part"), 4)


def correlation_states(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of the lines, from co-moments of their files."""
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = table(spark, sf, "lineitem").select(*numbers)
    kept = landed_states(lines, "l_extendedprice", ("columns", "pairs"))
    return rounded(states.correlation(kept), 6, "r")


def profile_tables(spark: SparkSession, sf: str) -> DataFrame:
    tables = {name: table(spark, sf, name) for name in ("customer", "supplier")}
    return rounded(exploration.profile_tables(tables, without_duplicates=("customer",)), 4)


def date_range(spark: SparkSession, sf: str) -> DataFrame:
    ends = prof.value_range(table(spark, sf, "orders"), "o_orderdate")
    return ends.select(*[F.col(c).cast("string").alias(c) for c in ends.columns])


# ---- distributions ----


def topk_values(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are counted per nation before the names are joined."""
    counts = dist.value_counts(table(spark, sf, "customer"), "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = joins.join_dimension(counts, nations, "c_nationkey").select("n_name", "count")
    return named.orderBy(F.desc("count"), "n_name").limit(10)


def topk_brands(spark: SparkSession, sf: str) -> DataFrame:
    return dist.top_values(table(spark, sf, "part"), "p_brand", 10)


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dist.value_counts(gappy_events(spark, sf), "event_type")


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    chosen = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return dist.first_rows(chosen, ["o_orderkey"], 10)


def last_rows(spark: SparkSession, sf: str) -> DataFrame:
    chosen = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return dist.last_rows(chosen, ["o_orderkey"], 10)


def hist_equal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dist.histogram(table(spark, sf, "lineitem"), "l_quantity", 10), 9)


def hist_edges(spark: SparkSession, sf: str) -> DataFrame:
    return dist.histogram_of_edges(
        table(spark, sf, "lineitem"), "l_quantity", [1, 5, 10, 20, 25, 30, 40, 50]
    )


def hist_auto(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dist.automatic_histogram(table(spark, sf, "events"), "value"), 6)


def boxplot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dist.box_statistics(table(spark, sf, "events"), "value", ["event_type"]), 6)


def boxplot_total(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dist.box_statistics(table(spark, sf, "orders"), "o_totalprice"), 6)


def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(dist.correlation(table(spark, sf, "lineitem"), numbers), 6)


def scatter_sample(spark: SparkSession, sf: str) -> DataFrame:
    return dist.scatter_sample(
        table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 0.2, SEED
    )


def scatter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dist.scatter_counts(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 20, 20)


# ---- sampling ----


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "orders"), ["o_orderkey"], 0.25, SEED).select(
        "o_orderkey", "o_totalprice"
    )


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    part = sampling.split_number(["o_orderkey"], [0.7, 0.3], SEED)
    return table(spark, sf, "orders").select("o_orderkey", part.alias("part"))


def hash_sample_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of rows whose key is null half of the time: no part is empty of them."""
    gappy = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("key"), "o_totalprice"
    )
    part = sampling.split_number(["key"], [0.5, 0.5], SEED, gappy.columns)
    counts = gappy.groupBy(F.col("key").isNull().alias("null_key")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(part).alias("share")
    )
    fair = F.abs(F.col("share") - 0.5) < 2.5 / F.sqrt("rows")
    return counts.select("null_key", "rows", fair.alias("fair"))


def hash_folds(spark: SparkSession, sf: str) -> DataFrame:
    fold = sampling.fold_number(["l_orderkey", "l_linenumber"], 3, SEED)
    lines = table(spark, sf, "lineitem").select(fold.alias("fold"))
    return dist.value_counts(lines, "fold")


def draws_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the draws that depend on the partitioning, as rows (check, holds)."""
    orders = table(spark, sf, "orders")
    rows = orders.count()
    sample = bernoulli_sample(spark, sf)
    parts = random_split(spark, sf)
    found = parts.agg(F.count(F.lit(1)), F.count_distinct("o_orderkey"), F.avg("part")).first()
    slack = 5 / rows**0.5
    strange = sample.join(orders.select("o_orderkey"), "o_orderkey", "left_anti").count()
    holds = {
        "sample is a subset": strange == 0,
        "sample has its share": abs(sample.count() / rows - 0.25) < slack,
        "parts are disjoint": found[0] == found[1],
        "parts cover all": found[1] == rows,
        "parts have their shares": abs(found[2] - 0.3) < slack,
    }
    return spark.createDataFrame(list(holds.items()), "check string, holds boolean")


def approximate_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the approximate quartiles are within a hundredth of their ranks."""
    quartiles = prof.summary_all(table(spark, sf, "orders")).where(
        F.col("column").isin("o_custkey", "o_totalprice") & F.col("stat").endswith("%")
    )
    wanted = quartiles.select("column", "stat", "value").collect()
    orders = table(spark, sf, "orders")
    shares = orders.agg(
        *[F.avg((F.col(q.column) <= q.value).cast("int")) for q in wanted],
        *[F.avg((F.col(q.column) < q.value).cast("int")) for q in wanted],
    ).first()
    rows = []
    for i, q in enumerate(wanted):
        share = float(q.stat.rstrip("%")) / 100
        near = shares[i + len(wanted)] - 0.01 <= share <= shares[i] + 0.01
        rows.append((q.column, q.stat, bool(near)))
    return spark.createDataFrame(rows, "column string, stat string, near boolean")


def bernoulli_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.bernoulli_sample(table(spark, sf, "orders"), 0.25, SEED)


def random_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "orders").select("o_orderkey").randomSplit([0.7, 0.3], seed=SEED)
    numbered = [part.withColumn("part", F.lit(i)) for i, part in enumerate(parts)]
    return numbered[0].unionByName(numbered[1])


# ---- text ----


def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    lengths = exploration.with_text_lengths(table(spark, sf, "documents"))
    return lengths.select("doc_id", "characters", "words")


def short_text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.char_count(F.col("text")).alias("characters"),
        text.word_count(F.col("text"), empty_as_null=False).alias("words"),
    )


def nonempty_text(spark: SparkSession, sf: str) -> DataFrame:
    return exploration.count_with_text(table(spark, sf, "conversations"))


def contracted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents have no apostrophes, so a sentence with some is appended."""
    return table(spark, sf, "documents").select(
        "doc_id", F.concat("text", F.lit(CONTRACTED)).alias("text")
    )


def contractions(spark: SparkSession, sf: str) -> DataFrame:
    revised = text.expand_contractions(F.col("text"))
    return contracted_documents(spark, sf).select("doc_id", revised.alias("revised_text"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = text.tokenize(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(words).alias("position", "word")
    )


def stopwords(spark: SparkSession, sf: str) -> DataFrame:
    words = text.tokenize(text.expand_contractions(F.col("text")))
    kept = text.remove_stop_words(words)
    return contracted_documents(spark, sf).select("doc_id", kept.alias("kept")).select(
        "doc_id",
        F.size("kept").alias("n_words"),
        F.concat_ws(" ", "kept").alias("revised_words"),
    )


def token_weights(spark: SparkSession, sf: str) -> DataFrame:
    words = text.remove_stop_words(text.tokenize(F.col("text")))
    scratch = scratch_path(spark, "terms.parquet")
    weights = token_tfidf(table(spark, sf, "documents"), "doc_id", words, scratch)
    return rounded(weights, 6)


# ---- features ----


def binarized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        binarize(F.col("p_size")).alias("label"),
        binarize(F.nullif("p_size", F.lit(1)), 25).alias("large"),
    )


def string_index(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return index_categories(parts, "p_brand", "brand_index", ["p_partkey"])


def index_labels(spark: SparkSession, sf: str) -> DataFrame:
    return category_index(table(spark, sf, "part"), "p_name", "name_index")


def gappy_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the brand missing where the size is 7."""
    brand = F.when(F.col("p_size") != 7, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", brand.alias("p_brand"))


def index_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Brands indexed by a stored table that some of them are not in, in all three ways.

    With ``error`` only rows whose brand is in the table are given.
    """
    parts = gappy_parts(spark, sf)
    seen = parts.where(~F.col("p_brand").endswith("5"))
    fitted = stored(fit_categories(seen, "p_brand"), scratch_path(spark, "brands.parquet"))
    rows = {"skip": parts, "keep": parts, "error": seen}
    modes = [
        apply_categories(df, fitted, "p_brand", "brand_index", mode, ["p_partkey"]).select(
            F.lit(mode).alias("mode"), "p_partkey", "p_brand", "brand_index"
        )
        for mode, df in rows.items()
    ]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


def scale_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and sizes on scales that were stored for small parts."""
    parts = gappy_parts(spark, sf)
    fitted = fit_scale(parts.where("p_size <= 30"), ["p_retailprice", "p_size"])
    fitted = stored(fitted, scratch_path(spark, "scales.parquet"))
    both = apply_scale(parts, fitted, {"p_retailprice": "price_scaled"})
    both = apply_scale(both, fitted, {"p_size": "size_scaled"}, clip=True)
    return rounded(both.select("p_partkey", "price_scaled", "size_scaled"), 9)


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    stages = [
        StringIndexer(inputCol="p_type", outputCol="type_index"),
        OneHotEncoder(inputCol="type_index", outputCol="type_vector", dropLast=False),
    ]
    encoded = Pipeline(stages=stages).fit(parts).transform(parts)
    return encoded.select(
        "p_partkey", F.posexplode(vector_to_array("type_vector")).alias("level", "is_level")
    )


def one_hot_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """The set levels only: one row per part, however many levels there are."""
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    stages = [
        StringIndexer(inputCol="p_type", outputCol="type_index"),
        OneHotEncoder(inputCol="type_index", outputCol="type_vector", dropLast=False),
    ]
    encoded = Pipeline(stages=stages).fit(parts).transform(parts)
    return encoded.select("p_partkey", F.explode(F.unwrap_udt("type_vector")["indices"]).alias("level"))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    prices = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.lit(7).alias("same"))
    both = min_max(min_max(prices, "p_retailprice", "price_scaled"), "same", "same_scaled")
    return rounded(both, 9, "price_scaled")


def hashed_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    revised = contracted_documents(spark, sf).withColumn(
        "revised_text", text.expand_contractions(F.col("text"))
    )
    options = training.Options()
    terms = PipelineModel(stages=training.term_stages(options)).transform(revised)
    terms = stored(terms.select("doc_id", "word_features"), scratch_path(spark, "terms.parquet"))
    weighted = training.weight_stage(options).fit(terms).transform(terms)
    vectors = weighted.select("doc_id", F.unwrap_udt("IDF_features").alias("vector"))
    entries = vectors.select(
        "doc_id", F.inline(F.arrays_zip("vector.indices", "vector.values"))
    ).toDF("doc_id", "bucket", "weight")
    return rounded(entries, 6, "weight")


def stored_terms(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, terms) of the documents, tokenised once and written."""
    words = text.remove_stop_words(text.tokenize(F.col("text")))
    counted = table(spark, sf, "documents").select("doc_id", text.term_counts(words).alias("terms"))
    return stored(counted, scratch_path(spark, "terms.parquet"))


def bucket_index(spark: SparkSession, sf: str) -> DataFrame:
    """The hash bucket of every distinct term."""
    return hashing.bucket_index(hashing.vocabulary(stored_terms(spark, sf)))


def bucket_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The terms behind every bucket that has any."""
    index = hashing.bucket_index(hashing.vocabulary(stored_terms(spark, sf)))
    return hashing.bucket_terms(index, 3).withColumn("examples", F.concat_ws(",", "examples"))


def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed term counts of the documents, from counts of the terms and the index."""
    terms = stored_terms(spark, sf)
    index = stored(hashing.bucket_index(hashing.vocabulary(terms)), scratch_path(spark, "index.parquet"))
    return hashing.bucket_counts(terms, index)


def vector_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, from the vectors of the pipeline's text stages."""
    documents = table(spark, sf, "documents").withColumnRenamed("text", "revised_text")
    hashed = PipelineModel(stages=training.term_stages(training.Options())).transform(documents)
    return hashing.vector_counts(hashed)


# ---- training: documents as reviews, their sources as businesses ----


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as reviews of their source: five stars or one."""
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return joins.join_dimension(documents, labels, "doc_id").select(
        F.col("source").alias("business_id"),
        F.lit(None).cast("string").alias("date"),
        F.col("doc_id").cast("string").alias("review_id"),
        (1 + 4 * F.col("quality")).cast("double").alias("stars"),
        "text",
        F.col("toxic").cast("bigint").alias("useful"),
    )


def businesses(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as businesses, with the rating and attributes taken from their documents."""
    rated = labelled_documents(spark, sf).groupBy(F.col("source").alias("business_id"))
    facts = rated.agg(
        F.count(F.lit(1)).alias("review_count"),
        (F.floor(F.avg("quality") * 8) / 2 + 1).alias("stars"),
        F.avg("n_chars").alias("chars"),
        F.avg((F.col("lang") == "en").cast("int")).alias("english"),
    )
    return facts.select(
        "business_id",
        F.concat(F.lit("Source "), "business_id").alias("name"),
        "review_count",
        "stars",
        F.lit(1).alias("is_open"),
        F.struct(
            F.when(F.col("chars") > 2500, "loud").otherwise("quiet").alias("NoiseLevel"),
            F.when(F.col("english") > 0.6, "casual").otherwise("touristy").alias("Ambience"),
        ).alias("attributes"),
    )


def review_frame(spark: SparkSession, sf: str, fraction: float = 1.0) -> DataFrame:
    return training.training_frame(reviews(spark, sf), businesses(spark, sf), fraction, SEED)


def training_frame(spark: SparkSession, sf: str) -> DataFrame:
    frame = review_frame(spark, sf, 0.4)
    return frame.select(
        "review_id",
        "business_id",
        "review_stars",
        "business_name",
        "business_review_count",
        "business_stars",
        "business_noiselevel",
        "business_ambience",
        F.length("revised_text").alias("revised_length"),
    )


def trained(
    spark: SparkSession, sf: str, options: training.Options = training.Options()
) -> tuple[training.Trained, DataFrame, DataFrame]:
    """(trained model, training part, predictions for the test part)."""
    frame = stored(review_frame(spark, sf), scratch_path(spark, "frame.parquet"))
    learn, test = training.split_frame(frame, options)
    model = training.train(learn, options)
    return model, learn, model.model.transform(test)


WITH_TEXT = training.Options(text_features=True)


def train_score(spark: SparkSession, sf: str) -> DataFrame:
    _, _, predictions = trained(spark, sf)
    return training.with_score(predictions).select("review_id", "label", "prediction", "score")


def train_text(spark: SparkSession, sf: str) -> DataFrame:
    _, _, predictions = trained(spark, sf, WITH_TEXT)
    return training.evaluate(predictions)["metrics"]


def cv_grid(spark: SparkSession, sf: str) -> DataFrame:
    model, learn, _ = trained(spark, sf)
    return training.grid_scores(model, learn)


def best_params(spark: SparkSession, sf: str) -> DataFrame:
    model, learn, _ = trained(spark, sf)
    return training.best_parameters(model, learn)


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    model, _, predictions = trained(spark, sf)
    return training.coefficients(model, predictions)


def training_roc(spark: SparkSession, sf: str) -> DataFrame:
    model, learn, _ = trained(spark, sf)
    return training.evaluate(model.model.transform(learn))["roc"]


def model_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of one training run, each as a row (check, holds)."""
    model, learn, predictions = trained(spark, sf)
    grid = training.grid_scores(model, learn).collect()
    chosen = {r.param: float(r.value) for r in training.best_parameters(model, learn).collect()
              if r.param in ("regParam", "elasticNetParam")}
    best = max(grid, key=lambda r: r.auc)
    scored = training.with_score(predictions)
    wrong = scored.where((F.col("score") > 0.5) != (F.col("prediction") == 1)).count()
    names = training.coefficients(model, predictions).collect()
    evaluated = training.evaluate(predictions)
    area = evaluated["auc"].first().auc
    curve = sorted((r.fpr, r.tpr) for r in evaluated["roc"].collect())
    under = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    holds = {
        "four grid points": len({(r.reg_param, r.elastic_net_param) for r in grid}) == 4,
        "one best point": [r.best for r in grid].count(True) == 1 and best.auc == max(
            r.auc for r in grid if r.best),
        "best point is fitted": chosen == {
            "regParam": next(r.reg_param for r in grid if r.best),
            "elasticNetParam": next(r.elastic_net_param for r in grid if r.best)},
        "predictions follow scores": wrong == 0,
        "coefficients are numbered": [r.idx for r in names] == list(range(len(names))),
        "roc ends": curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0),
        "roc rises": all(a[1] <= b[1] for a, b in zip(curve, curve[1:])),
        "roc area is the auc": abs(under - area) < 1e-9,
    }
    return spark.createDataFrame(list(holds.items()), "check string, holds boolean")


def fit_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each grid point is at its optimum, on the rows it was fitted on.

    At (1, 1) the optimum is known: no coefficient, and the log odds as the intercept.
    """
    frame = stored(review_frame(spark, sf), scratch_path(spark, "frame.parquet"))
    learn, _ = training.split_frame(frame)
    points = training.grid_optimality(learn)
    null_point = (F.col("reg_param") == 1) & (F.col("elastic_net_param") == 1)
    return points.select(
        "reg_param",
        "elastic_net_param",
        "rows",
        (F.col("residual") < 1e-4).alias("optimal"),
        F.when(null_point, F.col("nonzero")).alias("nonzero"),
        F.when(null_point, F.round("intercept", 6)).alias("intercept"),
    )


def fold_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """What the feature stages, text included, learn on the training side of each fold."""
    terms = PipelineModel(stages=training.term_stages(WITH_TEXT)).transform(review_frame(spark, sf))
    folded = training.with_folds(terms, WITH_TEXT)
    return training.fold_statistics(folded, WITH_TEXT)


def null_point_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the test rows by the model of the grid point (1, 1)."""
    options = training.Options(reg_params=(1.0,), elastic_net_params=(1.0,), validate=False)
    _, _, predictions = trained(spark, sf, options)
    scored = training.with_score(predictions)
    return rounded(scored.select("review_id", "label", "prediction", "score"), 9, "score")


def coefficient_names(spark: SparkSession, sf: str) -> DataFrame:
    """The features of the coefficient table, in the order of the vector."""
    model, _, predictions = trained(spark, sf)
    return training.coefficients(model, predictions).select("idx", "name")


def expression_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the coefficients, taken by name over raw columns, give the scores of the pipeline."""
    model, _, predictions = trained(spark, sf)
    named = training.coefficients(model, predictions)
    expression = training.score_expression(model, named)
    scored = training.with_score(predictions).withColumn("again", expression)
    return scored.select(
        "review_id",
        (F.abs(F.col("again") - F.col("score")) < 1e-9).alias("same_score"),
        ((F.col("again") > 0.5) == (F.col("prediction") == 1)).alias("same_prediction"),
    )


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label and share of the test rows of the same run as ``train_score``."""
    _, _, predictions = trained(spark, sf)
    return predictions.select("review_id", "label", F.col("prediction").isin(0.0, 1.0).alias("scored"))


def exploratory_features(spark: SparkSession, sf: str) -> DataFrame:
    options = training.Options(handle_invalid="error")
    frame = stored(review_frame(spark, sf), scratch_path(spark, "frame.parquet"))
    featured = training.exploratory_features(frame, options)
    return featured.select(
        "review_id", F.posexplode(vector_to_array("features")).alias("position", "value")
    )


def model_features(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feature vector, scaled count first; entries that are not zero."""
    options = training.Options(handle_invalid="error")
    frame = stored(review_frame(spark, sf), scratch_path(spark, "frame.parquet"))
    featured = Pipeline(stages=training.model_stages(options)).fit(frame).transform(frame)
    entries = featured.select(
        "review_id", F.posexplode(vector_to_array("features")).alias("position", "value")
    )
    return entries.where("value != 0").withColumn("value", F.round("value", 9))


def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows the stored model scores differently from the stored predictions: none."""
    model, learn, predictions = trained(spark, sf)
    layout = Layout(scratch_path(spark, "store"))
    training.save(model, predictions, layout)
    stored = read_parquet(spark, layout.trusted("predictions"))
    again = PipelineModel.load(layout.model("pipeline")).transform(
        stored.select(*[c for c in learn.columns])
    )
    pairs = again.select("review_id", F.col("prediction").alias("again")).join(
        stored.select("review_id", "prediction"), "review_id"
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("again") != F.col("prediction")).alias("different"),
    )


QUERIES: dict[str, Query] = {
    "confusion": confusion,
    "class_metrics": class_metrics,
    "roc_points": roc_points,
    "auc_exact": auc_exact,
    "roc_bounded": roc_bounded,
    "json_roundtrip": json_roundtrip,
    "json_inferred": json_inferred,
    "parquet_roundtrip": parquet_roundtrip,
    "struct_lift": struct_lift,
    "clean_dropna": clean_dropna,
    "null_report": null_report,
    "rename_join": rename_join,
    "rename_join_salted": rename_join_salted,
    "bucketed_join": bucketed_join,
    "skewed_join": skewed_join,
    "cleaning_job": cleaning_job,
    "rejected_lines": rejected_lines,
    "landing_variant": landing_variant,
    "variant_rejects": variant_rejects,
    "schema_profile": schema_listing,
    "typed_dates": typed_dates,
    "dup_rows_events": dup_rows_events,
    "hash_sample_null_keys": hash_sample_null_keys,
    "draws_checked": draws_checked,
    "approximate_ranks": approximate_ranks,
    "null_counts": null_counts,
    "nonnull_counts": nonnull_counts,
    "null_rows": null_rows,
    "null_columns": null_columns,
    "row_counts": row_counts,
    "dup_rows": dup_rows,
    "describe_numeric": describe_numeric,
    "describe_table": describe_table,
    "summary_subset": summary_subset,
    "summary_approx": summary_approx,
    "sketch_quartiles": sketch_quartiles,
    "profile_table": profile_table,
    "profile_states": profile_states,
    "correlation_states": correlation_states,
    "profile_tables": profile_tables,
    "date_range": date_range,
    "topk_values": topk_values,
    "topk_brands": topk_brands,
    "value_counts": value_counts,
    "first_rows": first_rows,
    "last_rows": last_rows,
    "hist_equal": hist_equal,
    "hist_edges": hist_edges,
    "hist_auto": hist_auto,
    "boxplot": boxplot,
    "boxplot_total": boxplot_total,
    "corr_matrix": corr_matrix,
    "scatter_sample": scatter_sample,
    "scatter_counts": scatter_counts,
    "hash_sample": hash_sample,
    "hash_split": hash_split,
    "hash_folds": hash_folds,
    "bernoulli_sample": bernoulli_sample,
    "random_split": random_split,
    "text_lengths": text_lengths,
    "short_text_lengths": short_text_lengths,
    "nonempty_text": nonempty_text,
    "contractions": contractions,
    "tokens": tokens,
    "stopwords": stopwords,
    "token_tfidf": token_weights,
    "binarize": binarized,
    "string_index": string_index,
    "index_labels": index_labels,
    "index_unseen": index_unseen,
    "scale_unseen": scale_unseen,
    "one_hot": one_hot,
    "one_hot_sparse": one_hot_sparse,
    "min_max": scaled,
    "hashed_tfidf": hashed_tfidf,
    "bucket_index": bucket_index,
    "bucket_terms": bucket_terms,
    "bucket_counts": bucket_counts,
    "vector_counts": vector_counts,
    "training_frame": training_frame,
    "train_score": train_score,
    "train_text": train_text,
    "cv_grid": cv_grid,
    "best_params": best_params,
    "coefficients": coefficients,
    "training_roc": training_roc,
    "model_checks": model_checks,
    "model_features": model_features,
    "fit_optimality": fit_optimality,
    "fold_statistics": fold_statistics,
    "null_point_scores": null_point_scores,
    "coefficient_names": coefficient_names,
    "expression_scores": expression_scores,
    "scored_labels": scored_labels,
    "exploratory_features": exploratory_features,
    "model_roundtrip": model_roundtrip,
}
