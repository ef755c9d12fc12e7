"""URL filters: written rules first, and for urls that no rule fits a logistic regression on hashed character n-grams of host and path.

Only DataFrame and SQL functions. A url's features are the distinct buckets of its n-grams, host and path apart. The model is fitted on a
small labelled table, gathered in one row, by steps down the gradient that one SQL expression folds over that row. Weights, errors and
chances are integers of fixed point, so the model is the same in whatever order its rows come and on whatever engine runs the same SQL.
The rest is one pass over (page_id, url) in which the weights are a constant: no shuffle, no join, and html is never read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A verdict for a host and its subdomains, where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Rules stand in the plan as an expression; more than this many are refused.
MOST_RULES = 1000

#: The labelled urls that a model is trained on unless others are given.
BLOCKED = (
    "http://www.cheap-meds.example/en/buy/viagra", "https://blog.pills-online.example/fr/order", "http://buy-pills.example/en/cheap/", "https://m.casino-royal.example/en/slots/1",
    "http://online-casino.example/de/bonus.html", "https://www.win-big.example/es/casino/", "http://free-spins.example/en/play", "https://sports-bets.example/en/odds/61",
    "http://m.bets-online.example/fr/free/", "https://adult-video.example/en/watch/3", "http://blog.x-adult.example/es/cams", "https://www.xxx-tube.example/adult/9",
    "http://spam-links.example/en/farm/2", "https://link-farm.example/de/seo", "http://www.spam-host.example/en/712", "https://ads-server.example/en/click?id=3",
    "http://track-ads.example/fr/pixel", "https://m.tracker.example/en/ads/7", "http://blog.ads-click.example/en/banner.html", "https://replica-watches.example/de/sale",
    "http://www.payday-loans.example/en/apply", "https://fast-loans.example/es/cash/", "http://get-rich.example/en/win/", "https://free-prize.example/en/win/claim#top",
)
ALLOWED = (
    "https://www.library.example/en/catalogue", "http://museum.example/fr/visite.html", "https://blog.gardens.example/de/rosen/", "http://news.example/es/1204",
    "https://university.example/en/physics/12", "http://m.weather.example/en/today", "https://www.parliament.example/fr/seance/44", "http://recipes.example/es/sopa.html",
    "https://blog.mountains.example/en/routes?page=2", "http://history.example/de/mittelalter/7", "https://maps.example/en/roads/55", "http://www.hospital.example/fr/services",
    "https://schools.example/en/calendar", "http://trains.example/de/fahrplan", "https://m.birds.example/en/songs/18", "http://dictionary.example/es/palabra/301",
    "https://www.observatory.example/en/images/9.html", "http://theatre.example/fr/saison/", "https://chess.example/de/partien/1000", "http://blog.cities.example/en/27/",
    "https://lectures.example/en/algebra/3#top", "http://www.archive.example/es/1898", "https://rivers.example/de/donau", "http://poems.example/fr/83.html",
    "https://harbour.example/en/ships/210", "http://www.council.example/en/minutes/66", "https://journal.example/en/issue/5?page=1", "http://m.cinema.example/es/hoy",
    "https://volcano.example/en/report/31", "http://orchestra.example/de/konzerte/", "https://www.bridges.example/fr/ponts/12", "http://farmers.example/en/markets/4",
)
#: At most so many labelled rows are fitted, taken by a hash of the url.
MOST_LABELLED = 1000

#: Characters of an n-gram; buckets, of which 0 is the bias that every url has; and the multipliers of a host's and of a path's n-grams.
N, BUCKETS = 3, 1 << 14
HOST, PATH = (7919, 104729, 1299709), (6101, 75011, 999983)
#: The integer that stands for 1; steps of the fit; and by what the summed error and the weight are divided in each step.
ONE, STEPS, RATE, DECAY = 1 << 20, 60, 32, 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; path: what follows up to ``?``, ``#`` or
    the end. Both are empty without ``://`` and for null."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def features_sql(host: str = "host", path: str = "path") -> str:
    """The distinct buckets of a url: 0, and one for each n-gram of the host and of the path, each between two marks."""

    def grams(text: str, by: tuple[int, ...]) -> str:
        hashed = " + ".join(f"ascii(c[i + {k}]) * {m}L" for k, m in enumerate(by))
        return f"flatten(transform(array(split(concat('^', {text}, '$'), '')), c -> transform(sequence(0, greatest(size(c) - {N}, 0)), i -> if(size(c) < {N}, 0, cast(1 + ({hashed}) % {BUCKETS - 1} as int)))))"

    return f"array_distinct(concat(array(0), {grams(host, HOST)}, {grams(path, PATH)}))"


def chance_sql(total: str) -> str:
    """The logistic function of a sum of weights, in fixed point."""
    return f"cast(floor({ONE}D / (1D + exp(-({total}) / {ONE}D))) as bigint)"


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block) of :data:`BLOCKED` and :data:`ALLOWED`."""
    listed = lambda urls: F.array(*[F.lit(u) for u in urls])
    one = spark.range(1)
    return one.select(F.explode(listed(BLOCKED)).alias("url"), F.lit(1).alias("block")).unionByName(one.select(F.explode(listed(ALLOWED)).alias("url"), F.lit(0).alias("block")))


def fit(labelled: DataFrame) -> dict[int, int]:
    """Weights of the buckets that occur in ``labelled`` (url, block: 1 or 0), in fixed point.

    Rows with a null in either are left out; repeated rows count as often as they stand; an empty table gives no weights, so each
    url gets an even chance. Of more than :data:`MOST_LABELLED` rows, those with the smallest hashes are fitted.
    """
    rows = labelled.where("url is not null and block is not null").orderBy(F.xxhash64("url"), "url", "block").limit(MOST_LABELLED)
    host, path = host_and_path(F.col("url"))
    one = rows.select(F.col("block").cast("bigint").alias("y"), host.alias("host"), path.alias("path")).select("y", F.expr(features_sql()).alias("b")).agg(F.collect_list(F.struct("y", "b")).alias("e"))
    one = one.select("e", F.expr("array_sort(array_distinct(flatten(e.b)))").alias("used")).where("size(e) > 0")
    # places of each row's buckets among those in use, and the rows of each bucket
    place = one.select("used", F.col("e.y").alias("y"), F.expr("transform(e.b, b -> transform(b, x -> cast(array_position(used, x) - 1 as int)))").alias("b"), F.expr("transform(used, u -> filter(sequence(0, size(e) - 1), i -> array_contains(e.b[i], u)))").alias("p"))
    place = place.selectExpr("inline(array(struct(used, y, b, p)))")  # else they would be written into the fold and made anew in each step
    error = f"transform(b, (d, i) -> y[i] * {ONE}L - {chance_sql('aggregate(d, 0L, (s, k) -> s + w[k])')})"
    moved = f"zip_with(w, p, (v, at) -> v + cast(floor(aggregate(at, 0L, (s, i) -> s + err[i]) / {RATE}D) - floor(v / {DECAY}D) as bigint))"
    step = f"transform(array({error}), err -> {moved})[0]"
    found = place.select("used", F.expr(f"aggregate(sequence(1, {STEPS}), transform(used, u -> 0L), (w, n) -> {step})").alias("w")).first()
    return dict(zip(found.used, found.w, strict=True)) if found else {}


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits (of equally long ones the first by name) as (rule, verdict), else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}")
    if any(r.verdict not in ("allow", "block") for r in rules):
        raise ValueError("a rule's verdict is allow or block")
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, weights: dict[int, int], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict and score (the model's chance that the url is to be blocked, 0 to 1), row for row.

    Null and malformed urls have an empty host and path and are judged as such; other columns of ``pages`` are not read.
    """
    dense = [0] * BUCKETS
    for bucket, weight in weights.items():
        dense[bucket] = weight
    # the weights are one constant of the plan: its text is read once, when the plan is made
    table = F.split(F.lit(",".join(map(str, dense))), ",").cast("array<bigint>")
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("__w", table)
    score = F.expr(chance_sql(f"aggregate({features_sql()}, 0L, (s, k) -> s + __w[k])"))
    out = split.select("page_id", "host", "path", matched(F.col("host"), F.col("path"), rules).alias("__m"), score.alias("__p"))
    learnt = F.when(F.col("__p") * 2 > ONE, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("__m.rule").alias("rule"), F.coalesce(F.col("__m.verdict"), learnt).alias("verdict"), (F.col("__p") / F.lit(float(ONE))).alias("score"))


def without_blocked(pages: DataFrame, weights: dict[int, int], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``pages`` whose url is not blocked, with all their columns."""
    verdict = judge(pages.select(F.col("url"), F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page_id")), weights, rules)
    return verdict.where("verdict = 'allow'").select("page_id.*")
