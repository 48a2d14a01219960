"""URL filters: host and path rules first, trust carried over the host graph for the rest.

Hosts are the nodes. Edges are the links that pages carry to other hosts, and both
directions between a host and its parent host (``a.b.c`` and ``b.c``), and so on upwards.
Parents are nodes without pages too, so that sibling hosts meet in them; a parent of one
label (``net``) only where it has pages, and numeric hosts have none. Seeds come from
the rules: a host is trusted by its share of allowed pages and distrusted by its share of
blocked ones. Personalised PageRank carries trust forward from the trusted seeds, and
distrust against the edges from the blocked ones, until no further host is reached and all
ranks together are within ``settled`` times the seeds' sum of their limit: a host with no
trust is blocked however far its distrust came. A page that no rule fits is blocked when
its host's distrust exceeds ``threshold`` times its trust, and allowed otherwise; without
evidence it is allowed.

Only edges between distinct hosts, counted once, take part. The edges of a hub, and the pages of a
large host, lie in salted groups; a host's rank goes to those groups only that the host has, one row
for most.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed; null html has no links; repeated rows are judged each; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^\"'/?#>\s]+)"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SALTS = 16
NUMERIC = r"^[0-9.:]*$"
#: Rounds between two looks at whether the ranks have settled.
STEP = 8
#: Edges a task of a round; few rows in many tasks would write mostly empty shuffle files, round after round.
EDGES = 100_000


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    domain, start, _ = rule
    return ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))


def ruled(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, ruling``; the longest fitting rule wins."""
    named = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    pick = lambda value: F.coalesce(*[F.when(fits(F.col("host"), F.col("path"), r), F.lit(value(r))) for r in by_length])
    return named.withColumn("rule", pick(lambda r: r[0] + r[1])).withColumn("ruling", pick(lambda r: r[2]))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct ``src, dst, salt`` between different hosts; ``salt`` splits the edges of a hub."""
    linked = pages.select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst")
    ).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    # Each host and its ancestors with two labels or more: a.b.c.d, b.c.d, c.d.
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    nodes = hosts.filter(~F.col("host").rlike(NUMERIC)).select(F.explode(above).alias("host")).distinct()
    child = nodes.select("host", F.regexp_replace("host", r"^[^.]*\.?", "").alias("parent")).filter("parent != ''")
    kin = child.join(nodes.union(hosts.select("host")).distinct().select(F.col("host").alias("parent")), "parent", "left_semi")
    both = kin.select(F.col("host").alias("src"), F.col("parent").alias("dst")).union(kin.select("parent", "host"))
    return linked.filter("src != '' and dst != src").union(both).distinct().withColumn("salt", F.pmod(F.xxhash64("src", "dst"), F.lit(SALTS)).cast("int"))


def propagated(seeds: DataFrame, edges: DataFrame, column: str, rounds: int | None, damping: float, settled: float = 1e-6) -> DataFrame:
    """Personalised PageRank of ``host, seed`` over ``src, dst, salt``: ``host, <column>`` of the hosts that it reaches.

    After ``rounds`` rounds, or else at its limit: until as many hosts have rank as ``STEP`` rounds
    before, and the sum of all distances to the limit is ``settled`` times the seeds' sum at most.
    """
    counts = edges.groupBy("src", "salt").count()
    # The salted groups that each host has, SALTS rows at most, with what each edge carries of the host's rank.
    groups = cut(counts.select(F.col("src").alias("host"), "salt", (damping / F.sum("count").over(Window.partitionBy("src"))).alias("carried")))
    out = cut(edges.select(F.col("src").alias("host"), "salt", "dst"))
    rank = seeds.filter("seed > 0").select("host", F.col("seed").alias(column))
    own = ((1 - damping) * F.col(column)).alias(column)
    if not (size := out.count()):
        return rank.select("host", own)
    tasks = 1 + size // EDGES
    out, rank, groups = cut(out.coalesce(tasks)), cut(rank.coalesce(tasks)), groups.coalesce(tasks)
    given, share, to, come = rank.select("host", own), (F.col(column) * F.col("carried")).alias(column), F.col("dst").alias("host"), F.sum(column).alias(column)

    def after(rank: DataFrame) -> DataFrame:
        sent = rank.join(groups, "host").select("host", "salt", share).join(out, ["host", "salt"]).select(to, column)
        # The seeds' own share is one more message, so that a round is one aggregation by host.
        return given.union(sent).coalesce(tasks).groupBy("host").agg(come)

    if rounds is not None:
        for k in range(rounds):
            rank = after(rank)
            if k % 3 == 2:
                rank = cut(rank)
        return rank
    # From the seeds' own share on, ranks only grow: sums and counts tell what a look must know. A round brings
    # any two rankings closer by the damping: what is left follows from the last change.
    left = damping**STEP / (1 - damping**STEP)
    total = rank.agg(F.coalesce(F.sum(column), F.lit(0.0))).first()[0]
    rank, last, had = given, (1 - damping) * total, -1
    while True:
        for _ in range(STEP):
            rank = after(rank)
        rank = cut(rank)
        now, has = rank.agg(F.coalesce(F.sum(column), F.lit(0.0)), F.count("*")).first()
        if has == had and (now - last) * left <= settled * total:
            return rank
        last, had = now, has


def url_verdicts(
    pages: DataFrame, rules=RULES, rounds: int | None = None, damping: float = 0.85, threshold: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Rows ``page_id, host, path, rule, verdict, trust, distrust``, one for each page."""
    judged = ruled(pages.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "page_id"), (url_col, "url"), (html_col, "html"))]), rules)
    hosts = cut(
        judged.filter("host != ''")
        .groupBy("host")
        .agg(F.avg(F.coalesce(F.col("ruling") == "allow", F.lit(False)).cast("double")).alias("good"), F.avg(F.coalesce(F.col("ruling") == "block", F.lit(False)).cast("double")).alias("bad"))
    )
    edges = cut(host_edges(judged, hosts))
    # Both directions in one run: "+" before a host is its trust, "-" its distrust.
    named = lambda sign, *of: [F.concat(F.lit(sign), c).alias(c) for c in of]
    seeds = hosts.select(*named("+", "host"), F.col("good").alias("seed")).union(hosts.select(*named("-", "host"), F.col("bad").alias("seed")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "salt")
    both = edges.select(*named("+", "src", "dst"), "salt").union(back.select(*named("-", "src", "dst"), "salt"))
    found = propagated(seeds, both, "rank", rounds, damping)
    of = lambda sign, name: found.filter(F.startswith("host", F.lit(sign))).select(F.expr("substring(host, 2)").alias("host"), F.col("rank").alias(name))
    trust, distrust = of("+", "trust"), of("-", "distrust")
    ranks = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    # A host may own a third of the pages: its verdict is met in the salted groups that it has.
    spread = judged.drop("html", "url").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    salted = spread.select("host", "salt").distinct().join(ranks, "host")
    worse = F.coalesce(F.col("distrust") > threshold * F.col("trust"), F.lit(False))
    return spread.join(salted, ["host", "salt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", F.when(worse, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
