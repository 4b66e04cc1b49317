"""What a board or a service asks: read-only SQL over registered tables, time series for charts, and named reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import communities, graph, lookups, mentions, posts

#: Functions that reach beyond the tables. They are refused wherever they stand.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "input_file_name", "raise_error"}


class Refused(ValueError):
    """A statement that is not one query over the registered tables."""


def _walk(plan, names: list[list[str]], own: set[str], functions: set[str]) -> None:
    """Names of the tables, of the tables that the query itself defines, and of the functions in a parsed plan, subqueries included."""
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        names.append(_seq(plan.multipartIdentifier()))
    elif kind == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            own.add(pair._1().lower())
            _walk(pair._2(), names, own, functions)
    elif kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
        functions.add(kind)
    for e in _items(plan.expressions()):
        _expression(e, names, own, functions)
    for child in _items(plan.children()):
        _walk(child, names, own, functions)


def _expression(e, names: list[list[str]], own: set[str], functions: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        functions.add(_seq(e.nameParts())[-1].lower())
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _walk(e.plan(), names, own, functions)
    for child in _items(e.children()):
        _expression(child, names, own, functions)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _seq(seq) -> list[str]:
    return [str(x) for x in _items(seq)]


class Board:
    """Tables by name, and what is asked of them. Every answer is a DataFrame; nothing is computed until it is used. The tables
    become temporary views of the session under their names."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], as_of: str) -> None:
        self.spark, self.tables, self.as_of = spark, tables, as_of
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def sql(self, statement: str, limit: int = 100) -> DataFrame:
        """One SELECT over the registered tables, at most `limit` rows (1 to 1000) of its result.

        The statement is judged by the plan that Spark's parser makes of it: it must be a query, not a command, and all its relations
        must be registered tables or named by the query itself (WITH); files, table functions, and functions that reach outside are
        refused. The limit is set on the plan, so one that the statement has itself stays, and words in texts or names don't matter."""
        if not 1 <= limit <= 1000:
            raise Refused("limit must be from 1 to 1000")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parseQuery(statement)
        except Exception as e:
            raise Refused(f"not a query: {str(e).strip().splitlines()[0][:200]}") from None
        names, own, functions = [], set(), set()
        _walk(plan, names, own, functions)
        known = {t.lower() for t in self.tables}
        strange = [".".join(n) for n in names if len(n) != 1 or n[0].lower() not in known | own]
        if strange:
            raise Refused(f"not registered: {', '.join(sorted(set(strange)))}")
        if bad := functions & (FORBIDDEN | {"UnresolvedTableValuedFunction", "UnresolvedTVFAliases"}):
            raise Refused(f"not allowed: {', '.join(sorted(bad))}")
        return self.spark.sql(statement).limit(limit)

    def search(self) -> DataFrame:
        """The targets a chart can ask for."""
        return lookups.sources(self.tables["posts"]).select("subreddit").orderBy("subreddit")

    def query(self, targets: list[str | None]) -> DataFrame:
        """Posts a day of each target, as points (target, time, value) in order of time; targets that are empty or unknown have none."""
        wanted = [t for t in targets if t]
        return lookups.daily_counts(self.tables["posts"], wanted).select("target", F.col("date").alias("time"), F.col("n").alias("value")).orderBy("target", "time")

    def routes(self) -> dict[str, Callable[..., DataFrame]]:
        """The reports by path; names in braces are arguments."""
        t, at = self.tables, self.as_of
        m = t["mentions"]
        return {
            "/info": lambda: lookups.table_counts(t),
            "/posts": lambda **k: posts.search(t["posts"], **k),
            "/posts/{id}": lambda id: lookups.by_key(t["posts"], "id", id),
            "/comments": lambda q="", **k: posts.search_comments(t["comments"], q, **k),
            "/subreddits": lambda: lookups.sources(t["posts"]),
            "/subreddits/summary": lambda: posts.group_summary(t["posts"], t["comments"]),
            "/subreddits/{subreddit}/stats": lambda subreddit: posts.group_stats(t["posts"].where(F.col("subreddit") == subreddit)),
            "/tickers/trending": lambda window_hours=48, limit=25: mentions.trending(m, at, window_hours, limit),
            "/tickers/{ticker}/sentiment": lambda ticker, window_hours=168: mentions.entity_sentiment(mentions.since(m, at, window_hours).where(F.col("ticker") == ticker.upper().lstrip("$")), ["ticker", "subreddit"]),
            "/tickers/{ticker}/timeseries": lambda ticker, days=30: mentions.timeseries(mentions.since(m, at, days * 24), ticker),
            "/analytics/momentum": lambda window_days=30, top=25: mentions.momentum_ranked(mentions.since(m, at, window_days * 24), 1, top),
            "/analytics/pump-suspects": lambda window_days=90, least=20: mentions.pump_suspects(m, t["authors"], at, window_days * 24, least),
            "/graph/clusters": lambda window_days=7: communities.clusters(lookups.clean_threads(lookups.threads(mentions.since(m, at, window_days * 24), t["comments"]))),
            "/graph/propagation/{ticker}": lambda ticker, window_days=30: mentions.propagation(mentions.since(m, at, window_days * 24).where(F.col("ticker") == ticker.upper().lstrip("$"))),
            "/graph/influencers": lambda: graph.pagerank(posts.reply_edges(t["comments"], t["posts"]), rounds=100, tolerance=1e-6),
            "/query": self.sql,
            "/grafana/search": self.search,
            "/grafana/query": self.query,
        }

    def ask(self, path: str, **arguments) -> DataFrame:
        """The report of a path such as /tickers/T01/sentiment."""
        routes = self.routes()
        if path in routes:
            return routes[path](**arguments)
        have = path.strip("/").split("/")
        for route, report in routes.items():
            want = route.strip("/").split("/")
            if len(want) == len(have) and all(w.startswith("{") or w == h for w, h in zip(want, have, strict=True)):
                return report(**{w[1:-1]: h for w, h in zip(want, have, strict=True) if w.startswith("{")}, **arguments)
        raise KeyError(path)
