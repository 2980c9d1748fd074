"""Training sets: filters, context, deterministic splits and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def quality_text(text: Column, least: int = 50, most: int = 2000) -> Column:
    """The words joined by blanks, at most ``most`` of them; null for fewer than ``least``."""
    w = words(text)
    return F.when(F.size(w) >= least, F.array_join(F.slice(w, 1, most), " "))


def with_context(text: Column, **context: Column) -> Column:
    """A line for each known field, an empty line, and the text."""
    head = [F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in context.items()]
    lines = F.concat_ws("\n", *head)
    return F.when(lines == "", text).otherwise(F.concat(lines, F.lit("\n\n"), text))


def split_of(key: Column, validation: float = 0.1, seed: str = "0") -> Column:
    """train or validation by a hash of the key and a seed: the same on every run and cluster."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + seed))), 1, 8), 16, 10).cast("double")
    return F.when(h / 2**32 < validation, "validation").otherwise("train")


def fine_tuning_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, word_count and split of the documents that pass the filter."""
    t = quality_text(F.col("text"))
    out = docs.withColumn("text", t).where("text is not null")
    return out.select("doc_id", "source", F.size(words(F.col("text"))).alias("word_count"), split_of(F.col("doc_id")).alias("split"), with_context(F.col("text"), Source=F.col("source")).alias("text"))


def split_statistics(docs: DataFrame) -> DataFrame:
    """Per source: documents loaded, kept and dropped, and words of the kept ones."""
    n = F.size(words(F.coalesce(quality_text(F.col("text")), F.lit(""))))
    return docs.select("source", n.alias("n")).groupBy("source").agg(
        F.count("*").alias("loaded"),
        F.count_if(F.col("n") > 0).alias("kept"),
        F.count_if(F.col("n") == 0).alias("dropped"),
        F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 4).alias("mean_words"),
        F.min(F.when(F.col("n") > 0, F.col("n"))).alias("min_words"),
        F.max("n").alias("max_words"),
    )


def question_rows(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn after it: conv_id, turn, question, answer."""
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"]).where("question <> '' and answer <> ''")


def sliced(df: DataFrame, order: str, start: int, n: int) -> DataFrame:
    """Rows start to start + n - 1 in an order: an exact slice; only start + n rows are ever kept."""
    return df.orderBy(order).offset(start).limit(n)
