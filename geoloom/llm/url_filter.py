"""URL filters: listed rules first, then the ratio of two character language models.

URLs that a rule allows or blocks are the examples of two variable-order Markov models over characters. A context is kept
where it precedes at least ``share`` of the characters of one class, so however many URLs there are, no order
has more than 2 / share contexts and the table of both models is small enough to broadcast. Each order is smoothed by the
order below it (Witten-Bell), the lowest by even chances. A URL's score is the mean log-likelihood ratio of its
characters; the cut between the classes is set on examples held out from the counts. Everything is DataFrame functions,
and log ratios are whole millionths, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.common import named
from geoloom.session import settle

# Characters with a symbol of their own; all others share "*". "^" pads the start, "$" is the end.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#%:~+@,"
SYMBOLS = LETTERS + "*$"
ORDER, SHARE, FOLDS, REACH = 4, 1 / 500, 5, 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the query, action and host with the start of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def symbols_of(url: Column) -> Column:
    """The URL after its scheme, in the alphabet of the models."""
    body = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), r"(?s)^.*?://", "")
    return F.regexp_replace(body, r"(?s)[^a-z0-9/.\-_?=&#%:~+@,]", "*")


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """Add rule and action of the longest rule that fits host and path; of equally long ones the longer host's."""
    fits = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1].index("/") * -1, r[1])):
        at = rule.index("/")
        host, path = rule[:at], rule[at:]
        fit = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    best = F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,action:string>")
    return rows.withColumn("best", best).select("*", "best.rule", "best.action").drop("best")


def windows(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each character and the end: ``columns`` and the character with the ORDER symbols before it."""
    chars = F.split(F.concat(F.lit("^" * ORDER), "symbols", F.lit("$")), "")
    rows = rows.select(*columns, F.explode(F.array(chars)).alias("c"))  # the generator builds the array once
    window = F.transform(F.sequence(F.lit(0), F.size("c") - (ORDER + 1)), lambda i: F.concat(*[F.get("c", i + k) for k in range(ORDER + 1)]))
    return rows.select(*columns, F.explode(window).alias("window"))


def train(rows: DataFrame, share: float = SHARE) -> list[DataFrame]:
    """For each order the table (context, symbol, ratio): millionths of the log ratio, allowed over blocked.

    ``rows`` has symbols and action. A class without examples, or a context it never saw, has the chances of the order below.
    """
    both = {"allow": "a", "block": "b"}
    counted = windows(rows, "action").groupBy("action", "window").count()
    grams = settle(counted.groupBy("window").agg(*[F.sum(F.when(F.col("action") == k, F.col("count")).otherwise(0)).alias(v) for k, v in both.items()]))
    out, below = [], None
    for order in range(ORDER + 1):
        context = F.substring("window", ORDER + 1 - order, order) if order else F.lit("")
        pairs = grams.groupBy(context.alias("context"), F.substring("window", ORDER + 1, 1).alias("symbol")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        pairs = settle(pairs)
        figures = [*[F.sum(v).alias("n" + v) for v in "ab"], *[F.sum(F.when(F.col(v) > 0, 1).otherwise(0)).alias("t" + v) for v in "ab"]]
        sums = pairs.groupBy("context").agg(*figures)
        if order == 0:
            sums = pairs.agg(*figures).na.fill(0).withColumn("context", F.lit(""))  # one row, without examples too
            total = settle(sums.select(F.col("na").alias("all_a"), F.col("nb").alias("all_b")))
            kept = sums
        else:
            often = [(F.col("n" + v) > 0) & (F.col("n" + v) >= F.lit(share) * F.col("all_" + v)) for v in "ab"]
            kept = sums.crossJoin(F.broadcast(total)).where(often[0] | often[1]).drop("all_a", "all_b")  # one row of totals
        full = kept.select("*", F.explode(F.split(F.lit(SYMBOLS), "")).alias("symbol"))
        full = full.join(F.broadcast(full.select("context", "symbol").join(pairs, ["context", "symbol"])), ["context", "symbol"], "left").na.fill(0, ["a", "b"])
        if below is None:
            full = full.withColumn("la", F.lit(1 / len(SYMBOLS))).withColumn("lb", F.lit(1 / len(SYMBOLS)))
        else:
            lower = below.select(F.col("context").alias("shorter"), "symbol", F.col("pa").alias("la"), F.col("pb").alias("lb"))
            full = full.withColumn("shorter", F.substring("context", 2, order - 1) if order > 1 else F.lit("")).join(F.broadcast(lower), ["shorter", "symbol"])
        for v in "ab":
            n, t, low = F.col("n" + v), F.col("t" + v), F.col("l" + v)
            full = full.withColumn("p" + v, F.when(n > 0, (F.col(v) + t * low) / (n + t)).otherwise(low))
        below = settle(full.select("context", "symbol", "pa", "pb"))
        out.append(below.select("context", "symbol", F.round((F.log("pa") - F.log("pb")) * 1e6).cast("long").alias("ratio")))
    return out


def scores(rows: DataFrame, model: list[DataFrame]) -> DataFrame:
    """(row, sum, n): millionths summed over the n characters of each row of (row, symbols), each by its longest kept context."""
    each = windows(rows, "row").withColumn("symbol", F.substring("window", ORDER + 1, 1))
    for order, table in enumerate(model):
        table = table.select(F.col("context").alias(f"c{order}"), "symbol", F.col("ratio").alias(f"r{order}"))
        each = each.withColumn(f"c{order}", F.substring("window", ORDER + 1 - order, order) if order else F.lit(""))
        each = each.join(F.broadcast(table), [f"c{order}", "symbol"], "left")  # at most 2 / share contexts x 52 symbols
    ratio = F.coalesce(*[F.col(f"r{order}") for order in reversed(range(ORDER + 1))])
    return each.groupBy("row").agg(F.sum(ratio).alias("sum"), F.count(F.lit(1)).alias("n"))


def cut_of(examples: DataFrame) -> DataFrame:
    """One row (cut): the thousandth of the score that tells held-out examples (action, score) apart best.

    The sum of the shares of allowed examples at or above the cut and of blocked ones below it is greatest; ties go to the
    cut nearest to 0, then the smaller. Without examples of both classes it is 0. Scores beyond +-REACH count as REACH.
    """
    bin_ = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(F.col("score") / 1000))).cast("long")
    by = lambda action: F.sum(F.when(F.col("action") == action, 1).otherwise(0))
    bins = settle(examples.groupBy(bin_.alias("bin")).agg(by("allow").alias("a"), by("block").alias("b")))  # at most 2 REACH + 1 rows
    total = bins.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b")).where("all_a > 0 AND all_b > 0")
    tries = bins.select(F.col("bin").alias("cut")).crossJoin(F.broadcast(total))  # one row of totals
    below = bins.selectExpr("bin", "a AS below_a", "b AS below_b")
    # Bins below each cut: sums over the ordered bins, whose number is bounded.
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select(F.col("bin").alias("cut"), F.coalesce(F.sum("below_a").over(w), F.lit(0)).alias("low_a"), F.coalesce(F.sum("below_b").over(w), F.lit(0)).alias("low_b"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    gain = (wide("all_a") - wide("low_a")) * wide("all_b") + wide("low_b") * wide("all_a")
    best = tries.join(below, "cut").agg(F.max(F.struct(gain.alias("gain"), (-F.abs("cut")).alias("near"), (-F.col("cut")).alias("low"), "cut")).alias("m"))
    return best.select(F.coalesce(F.col("m.cut"), F.lit(0)).alias("cut"))


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, share: float = SHARE) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score (mean log ratio in millionths, rounded down).

    The verdict is the longest fitting rule's, else ``allow`` where the score reaches the cut. A null URL or one without ``://``
    has empty host and path and is scored as it stands; the empty URL is scored by its end alone. Very long URLs are scored
    whole. Equal URLs get equal verdicts, repeated rows and null keys stay, other columns are not read, and an empty table gives no rows.
    Without examples of both classes (no rule fits any row) every score is 0 and the verdict is ``allow``.
    """
    u = named(url)
    fold = F.pmod(F.conv(F.substring(F.md5(F.coalesce(u, F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(FOLDS))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), named(key).alias("key"), host_of(u).alias("host"), path_of(u).alias("path"),
                        symbols_of(u).alias("symbols"), fold.alias("fold"))
    rows = settle(ruled(rows, rules))
    model = train(rows.where("action IS NOT NULL AND fold <> 0"), share)
    got = settle(scores(rows, model))
    scored = rows.drop("symbols").join(got, "row").withColumn("score", F.floor(F.col("sum") / F.col("n")).cast("long"))
    cut = settle(cut_of(scored.where("action IS NOT NULL AND fold = 0").select("action", "score")))
    verdict = F.coalesce("action", F.when(F.floor(F.col("score") / 1000) >= F.col("cut"), "allow").otherwise("block"))
    return scored.crossJoin(F.broadcast(cut)).select("key", "host", "path", "rule", verdict.alias("verdict"), "score")  # one row


def _order_sql(order: int) -> str:
    context = f"substr(win, {ORDER + 1 - order}, {order})" if order else "''"
    kept = f", (SELECT na AS all_a, nb AS all_b FROM s0) WHERE (na > 0 AND na >= {SHARE!r} * all_a) OR (nb > 0 AND nb >= {SHARE!r} * all_b)" if order else ""
    low = (f"JOIN m{order - 1} l ON l.context = substr(f.context, 2) AND l.symbol = f.symbol" if order else "")
    la, lb = ("l.pa", "l.pb") if order else (f"{1 / len(SYMBOLS)!r}", f"{1 / len(SYMBOLS)!r}")
    return f"""
g{order} AS (SELECT {context} AS context, substr(win, {ORDER + 1}, 1) AS symbol, sum(a) AS a, sum(b) AS b FROM grams GROUP BY ALL),
s{order} AS (SELECT {'context' if order else "'' AS context"}, coalesce(sum(a), 0) AS na, coalesce(sum(b), 0) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb
  FROM g{order}{' GROUP BY context' if order else ''}),
f{order} AS (SELECT k.*, symbol FROM (SELECT s{order}.* FROM s{order}{kept}) k, alphabet),
m{order} AS (SELECT f.context, f.symbol,
  CASE WHEN na > 0 THEN (coalesce(a, 0) + ta * {la}::DOUBLE) / (na + ta) ELSE {la} END AS pa,
  CASE WHEN nb > 0 THEN (coalesce(b, 0) + tb * {lb}::DOUBLE) / (nb + tb) ELSE {lb} END AS pb
  FROM f{order} f LEFT JOIN g{order} g ON g.context = f.context AND g.symbol = f.symbol {low}),"""


URLS_SQL = rf"""
WITH rules AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for a, r in RULES)}) v(action, rule, rhost, rpath)),
u AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT row, page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, ('0x' || substr(md5(url), 1, 8))::BIGINT % {FOLDS} AS fold,
  regexp_replace(regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '(?s)^.*?://', ''), '[^a-z0-9/.\-_?=&#%:~+@,]', '*', 'g') AS symbols FROM u),
r AS (SELECT h.*, b.rule, b.action FROM h LEFT JOIN (SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row) b USING (row)),
alphabet AS (SELECT unnest(string_split('{SYMBOLS}', '')) AS symbol),
w AS (SELECT row, action, fold, substr(t, i, {ORDER + 1}) AS win FROM (SELECT row, action, fold, t, unnest(range(1, length(t) - {ORDER} + 1)) AS i
  FROM (SELECT row, action, fold, '{"^" * ORDER}' || symbols || '$' AS t FROM r))),
grams AS (SELECT win, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'block') AS b FROM w WHERE action IS NOT NULL AND fold <> 0 GROUP BY win),
{''.join(_order_sql(k) for k in range(ORDER + 1))}
m AS ({' UNION ALL '.join(f'SELECT {k} AS k, context, symbol, round((ln(pa) - ln(pb)) * 1e6)::BIGINT AS ratio FROM m{k}' for k in range(ORDER + 1))}),
e AS (SELECT DISTINCT win FROM w),
best AS (SELECT win, arg_max(ratio, k) AS ratio FROM e JOIN m ON m.symbol = substr(win, {ORDER + 1}, 1) AND m.context = substr(win, {ORDER + 1} - k, k) GROUP BY win),
sc AS (SELECT row, sum(ratio) AS s, count(*) AS n FROM w JOIN best USING (win) GROUP BY row),
x AS (SELECT r.*, floor(s::DOUBLE / n)::BIGINT AS score, greatest(-{REACH}, least({REACH}, floor(floor(s::DOUBLE / n) / 1000)))::BIGINT AS bin FROM r JOIN sc USING (row)),
hb AS (SELECT bin, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'block') AS b FROM x WHERE action IS NOT NULL AND fold = 0 GROUP BY bin),
tot AS (SELECT sum(a) AS all_a, sum(b) AS all_b FROM hb HAVING sum(a) > 0 AND sum(b) > 0),
tries AS (SELECT t.bin, (all_a - coalesce(sum(h.a), 0)) * all_b + coalesce(sum(h.b), 0) * all_a AS gain FROM hb t CROSS JOIN tot LEFT JOIN hb h ON h.bin < t.bin GROUP BY t.bin, all_a, all_b),
cut AS (SELECT coalesce((SELECT bin FROM tries ORDER BY gain DESC, abs(bin), bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN floor(score / 1000.0) >= cut THEN 'allow' ELSE 'block' END) AS verdict, score FROM x, cut
"""
