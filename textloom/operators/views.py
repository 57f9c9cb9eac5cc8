"""Views of predictions: counts, summaries, bars and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.scores import DEFAULT_LABEL, DISPLAY_ORDER, percent

# How a label looks.
STYLE_FIELDS = ("badge", "border", "glow", "text", "bar")
LABEL_STYLES = {
    "LEFT": ("bg-blue-500/12 text-blue-200 ring-1 ring-inset ring-blue-400/30", "border-blue-400/25", "from-blue-500/18 to-transparent", "text-blue-200", "bg-blue-400"),
    "CENTER": ("bg-slate-400/10 text-slate-200 ring-1 ring-inset ring-slate-400/25", "border-slate-400/20", "from-slate-300/14 to-transparent", "text-slate-200", "bg-slate-300"),
    "RIGHT": ("bg-rose-500/12 text-rose-200 ring-1 ring-inset ring-rose-400/30", "border-rose-400/25", "from-rose-500/18 to-transparent", "text-rose-200", "bg-rose-400"),
}
MODE_TITLES = {"article": "Article", "sentence": "Sentence", "paragraph": "Paragraph"}
# Texts of the panel.
NO_RUN = "Local MVP flow: input, classify, and inspect segment-level probabilities in one place."


def styles(spark: SparkSession) -> DataFrame:
    """label and its style, three rows."""
    return spark.createDataFrame([(k, *v) for k, v in LABEL_STYLES.items()], "label string, " + ", ".join(f"style_{f} string" for f in STYLE_FIELDS))


def modes(spark: SparkSession) -> DataFrame:
    """mode, title and display order of the three modes."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(MODE_TITLES.items())], "position int, mode string, title string")


def styled(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds the style of a label, that of the default label where it is null or unknown. The styles are three rows."""
    known = F.when(F.col(label).isin(*LABEL_STYLES), F.col(label)).otherwise(DEFAULT_LABEL)
    dim = styles(df.sparkSession).withColumnRenamed("label", "label__")
    return df.withColumn("known__", known).join(F.broadcast(dim), F.col("known__") == F.col("label__")).drop("known__", "label__")


# Fixed values in the next three: the texts themselves.
def headline(mode: Column, n: Column) -> Column:
    return F.when(mode == "article", "Whole article prediction").otherwise(F.concat(n.cast("string"), F.lit(" segment predictions")))


def run_summary(mode: Column, n: Column) -> Column:
    """The noun follows the mode, not the count; without a run a fixed text."""
    noun = F.when(mode == "article", "prediction").otherwise("segments")
    return F.when(n.isNull(), NO_RUN).otherwise(F.format_string("Latest run returned %d %s in %s mode.", n, noun, mode))


def mode_title(mode: Column) -> Column:
    return F.concat(F.upper(F.substring(mode, 1, 1)), F.substring(mode, 2, 64), F.lit(" analysis"))


def segment_counts(predictions: DataFrame) -> DataFrame:
    """Segments of each request, with headline and summary."""
    n = predictions.groupBy("request_id", "mode").agg(F.count(F.lit(1)).alias("n_segments"))
    return n.withColumn("headline", headline(F.col("mode"), F.col("n_segments"))).withColumn("summary", run_summary(F.col("mode"), F.col("n_segments")))


def top_signal(predictions: DataFrame) -> DataFrame:
    """The label of the first segment of each request: neither a majority nor the surest one."""
    first = predictions.groupBy("request_id").agg(F.min_by("label", "segment_index").alias("label"))
    return first.select("request_id", F.coalesce("label", F.lit(DEFAULT_LABEL)).alias("top_signal"))


def probability_bars(predictions: DataFrame) -> DataFrame:
    """One row for each segment and class in display order, with whole percents and the segment's number from 1."""
    bars = F.array(*(F.struct(F.lit(i).alias("display_rank"), F.lit(name).alias("label"), F.col(f"p_{name.lower()}").alias("p")) for i, name in enumerate(DISPLAY_ORDER)))
    each = predictions.select("request_id", (F.col("segment_index") + 1).alias("segment_number"), F.explode(bars).alias("b"))
    return each.select("request_id", "segment_number", "b.display_rank", "b.label", percent(F.col("b.p")).alias("percent"))


def highlight(predictions: DataFrame) -> DataFrame:
    """Segments with the style of their label; only modes that have several segments."""
    return styled(predictions.filter(F.col("mode") != "article").select("request_id", "segment_index", "text", "label"))


def segment_cards(predictions: DataFrame) -> DataFrame:
    """Segment number, text, label and whole percents, for each segment."""
    percents = (percent(F.col(f"p_{n.lower()}")).alias(f"{n.lower()}_percent") for n in DISPLAY_ORDER)
    return predictions.select("request_id", (F.col("segment_index") + 1).alias("segment_number"), "text", "label", *percents)


def panel_state(loading: Column, error: Column, n_results: Column) -> Column:
    """What the result panel shows: loading, else an error, else nothing yet, else results."""
    return F.when(loading, "loading").when(error.isNotNull(), "error").when(n_results.isNull(), "empty").otherwise("results")


# Extensions: summaries beyond the service's own.


def label_distribution(predictions: DataFrame, *by: str) -> DataFrame:
    """Segments by label at every level of a roll-up."""
    return predictions.rollup(*by).agg(*(F.count(F.when(F.col("label") == n, 1)).alias(f"n_{n.lower()}") for n in DISPLAY_ORDER), F.count(F.lit(1)).alias("n"))


def majority_label(predictions: DataFrame) -> DataFrame:
    """The most frequent label of each request; of equally frequent ones that with the least id."""
    n = predictions.groupBy("request_id", "label_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("request_id").agg(F.max_by("label", F.struct("n", -F.col("label_id"))).alias("majority_label"), F.max("n").alias("n"))
    return best.select("request_id", "majority_label", "n")


def mean_probabilities(predictions: DataFrame) -> DataFrame:
    """Means as decimals, so that they don't depend on the order of sums."""
    cols = [f"p_{n.lower()}" for n in DISPLAY_ORDER]
    sums = predictions.groupBy("request_id").agg(*(F.sum(F.col(c).cast("decimal(9,6)")).alias(c) for c in cols), F.count(F.lit(1)).alias("n"))
    return sums.select("request_id", *((F.col(c).cast("double") / F.col("n")).alias(f"mean_{c}") for c in cols))


def label_transitions(predictions: DataFrame) -> DataFrame:
    """How often one label follows another within a request."""
    from pyspark.sql import Window

    before = F.lag("label").over(Window.partitionBy("request_id").orderBy("segment_index"))
    pairs = predictions.withColumn("from_label", before).filter("from_label IS NOT NULL")
    return pairs.groupBy("from_label", F.col("label").alias("to_label")).agg(F.count(F.lit(1)).alias("n"))


def surest(predictions: DataFrame, k: int) -> DataFrame:
    """The k surest segments of each label; ties by request and segment. Each task sends k rows of a label at most."""
    from pyspark.sql import Window

    mine = F.element_at(F.create_map(*(x for n in DISPLAY_ORDER for x in (F.lit(n), F.col(f"p_{n.lower()}")))), F.col("label"))
    best = Window.partitionBy("label").orderBy(F.desc("p"), "request_id", "segment_index")
    ranked = predictions.select("label", "request_id", "segment_index", mine.alias("p")).withColumn("k", F.row_number().over(best))
    return ranked.filter(F.col("k") <= k).drop("k")
