"""Plug-ins: steps on posts and comments that users add, found in a folder and applied in the order of their files."""

from __future__ import annotations

import importlib.util
import inspect
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lexicon
from pulsegrid.functions import text as T
from pulsegrid.functions.numeric import r
from pulsegrid.operators import posts as P


class Plugin:
    """A plug-in takes DataFrames and returns DataFrames; what it doesn't override leaves them as they are."""

    name = "base"
    description = ""
    enabled = True

    def process_posts(self, posts: DataFrame) -> DataFrame:
        raise NotImplementedError

    def process_comments(self, comments: DataFrame) -> DataFrame:
        return comments


class SentimentTagger(Plugin):
    """Adds sentiment_score and sentiment_label to posts and comments."""

    name, description = "sentiment_tagger", "score and label of the lexicon sentiment"
    def _tagged(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        score = T.lexicon_score(T.words(F.concat_ws(" ", *columns)), lexicon.POSITIVE, lexicon.NEGATIVE, lexicon.INTENSIFIERS)
        return rows.withColumn("__s", score).withColumns({"sentiment_score": r(F.col("__s"), 3), "sentiment_label": T.label(F.col("__s"))}).drop("__s")

    def process_posts(self, posts: DataFrame) -> DataFrame:
        return self._tagged(posts, ["title", "selftext"])

    def process_comments(self, comments: DataFrame) -> DataFrame:
        return self._tagged(comments, ["body"])


class Deduplicator(Plugin):
    """One row for each permalink, or comment_id, the first by id; rows without one are dropped."""

    name, description = "deduplicator", "removes repeated posts and comments"

    def _first(self, rows: DataFrame, key: str, order: str) -> DataFrame:
        return P.keep_first(rows.where(F.col(key) != ""), key, [order, *[c for c in rows.columns if c not in (key, order)]]).select(*rows.columns)

    def process_posts(self, posts: DataFrame) -> DataFrame:
        return self._first(posts, "permalink", "id")

    def process_comments(self, comments: DataFrame) -> DataFrame:
        return self._first(comments, "comment_id", "post_id")


class KeywordExtractor(Plugin):
    """Adds keywords: the five words of three letters or more that a post holds most often, of equal ones the first by name."""

    name, description, top = "keyword_extractor", "the most frequent words of each post", 5

    def process_posts(self, posts: DataFrame) -> DataFrame:
        def counted(w: Column) -> Column:
            # Equal words stand together: a run's first place and the next run's first place give its count.
            firsts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i).otherwise(-1)), lambda i: i >= 0)
            runs = T.let(firsts, lambda f: F.transform(f, lambda a, i: F.struct((a - F.coalesce(F.get(f, i + 1), F.size(w))).alias("n"), F.get(w, a).alias("word"))))
            return F.transform(F.slice(F.array_sort(runs), 1, self.top), lambda x: x["word"])

        words = F.array_sort(T.words(F.concat_ws(" ", "title", "selftext"), 3))
        return posts.withColumn("keywords", F.array_join(T.let(words, counted), ","))


def load(folder: str | Path) -> tuple[list[Plugin], list[tuple[str, str]]]:
    """(enabled plug-ins, failures as (file, reason)) of the Python files in a folder, in the order of their names; names that begin with
    an underscore are skipped. Each subclass of Plugin that a file itself defines is one, in the order of its source."""
    found, failed = [], []
    for file in sorted(Path(folder).glob("*.py")):
        if file.name.startswith("_"):
            continue
        try:
            spec = importlib.util.spec_from_file_location(f"pulsegrid_plugin_{file.stem}", file)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            kinds = [c for c in vars(module).values() if inspect.isclass(c) and issubclass(c, Plugin) and c.__module__ == module.__name__]
            found += [p for p in (c() for c in kinds) if p.enabled]
        except Exception as e:  # a plug-in is foreign code: what it raises is reported, and the others are loaded
            failed.append((file.name, f"{type(e).__name__}: {e}"))
    return found, failed


def run(posts: DataFrame, comments: DataFrame, plugins: list[Plugin]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, comments, report): the plug-ins applied one after the other. One whose plan can't be made is skipped, posts and comments both,
    and the next goes on with what was there before it. report: place, name, applied, reason. Nothing is computed here; an
    error that only the data can raise comes up when the result is used."""
    said = []
    for i, p in enumerate(plugins):
        try:
            new = posts.transform(p.process_posts), comments.transform(p.process_comments)
            _ = [df.schema for df in new]
            posts, comments = new
            said.append((i, p.name, True, None))
        except Exception as e:
            said.append((i, p.name, False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return posts, comments, _table(posts.sparkSession, said)


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "place int, name string, applied boolean, reason string")
