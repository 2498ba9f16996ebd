"""URL filter: host/path rules, then trust and distrust spread over the host graph. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import UPPER, ascii_lower, stash, unstash

#: Mass of a seed vector. Masses are whole numbers and shares are rounded down, so sums don't
#: depend on the order of rows and a lost task gives the same verdicts when it runs again.
MASS = 10**9
#: Parts that a unit of mass is split into where hosts link to others or seeds have more than MANY
#: pages: MASS * FINE, times 100, has 31 digits, and a quotient of decimals may have 32.
FINE, MANY = 10**20, 10**6
#: Masses have settled when no more hosts are reached and none has changed, in four rounds, by more than
#: this part of its own (and by what rounding may move). More rounds than MOST raise.
SETTLED, MOST = 10**6, 10_000
#: The value of an anchor's href, with its quotes if it has some; attributes before it are passed over whole.
LINK = r"""(?i)<a(?=[\s/])(?:[\s/]*(?!href\s*=)[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*+[\s/]*href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: The SQL's links: quoted values without '>', and no '>' before them.
SQL_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["']"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. rules: (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) from columns host, html; links without a host lead to the page's own."""
    def target(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^(?:[hH][tT][tT][pP][sS]?:)?//"), F.translate(F.regexp_extract(x, r"//([^/?#]*)", 1), UPPER, UPPER.lower()))
            .when(x.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(""))
            .otherwise(F.col("host"))
        )

    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    links = F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    to = pages.select("host", F.explode(F.array_distinct(F.transform(links, target))).alias("dst"))
    return to.filter("host <> '' and dst <> ''").select(F.col("host").alias("src"), "dst").distinct()


def whole(x: str, y: str | int) -> str:
    """SQL of x // y for decimals; `div` gives a long."""
    return f"cast((({x}) - ({x}) % cast({y} as decimal(38, 0))) / cast({y} as decimal(38, 0)) as decimal(38, 0))"


def moved(last: DataFrame, rank: DataFrame, noise: int) -> bool:
    """Whether a host is reached anew or its mass has changed; rows are (host, kind, m)."""
    old = last.select("host", "kind", F.col("m").alias("was"))
    far = F.expr(f"was is null or m is null or abs(m - was) > greatest({noise}, {whole('m', SETTLED)})")
    return bool(rank.join(old, ["host", "kind"], "full").filter(far).limit(1).count())


def spread(edges: DataFrame, counts: DataFrame, damping: int, rounds: int) -> tuple[DataFrame, int]:
    """(host, trust, distrust) from counts (host, good, bad), in whole numbers, and the parts of a unit.

    Trust flows along edges, each host dealing its mass evenly; distrust flows against them. Both
    directions run in one loop, as rows (node, kind), so that each round is one join and one sum.
    Each fourth round is written to the shared folder: lineage stays short if executors are lost.
    There the masses are held against those four rounds before; `rounds` is the least number of rounds.
    No seed and no share is less than one part, so none dies out on the way.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("kind")).unionAll(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("kind"))
    )
    deg = both.groupBy("a", "kind").agg(F.count(F.lit(1)).alias("deg"))
    flow = stash(both.join(deg, ["a", "kind"]), "flow")
    total = counts.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    fine = FINE if max(total) > MANY or flow.filter("a <> b").limit(1).count() else 1
    seed = [F.expr(f"case when {n} > 0 then greatest(1, {whole(f'{MASS * fine}BD * {n}', max(1, t))}) end") for n, t in (("good", total.g), ("bad", total.b))]
    start = stash(counts.select("host", F.posexplode(F.array(*seed)).alias("kind", "seed")).filter("seed > 0"), "seeds")
    noise = 1000 + 10 * flow.count()
    rank, last, done = start.select("host", "kind", F.col("seed").alias("m")), None, 0
    while True:
        gain = flow.join(rank, (flow["a"] == rank["host"]) & (flow["kind"] == rank["kind"])).select(
            F.col("b").alias("host"), flow["kind"].alias("kind"), F.expr(f"greatest(1, {whole(f'{damping} * m', '100 * deg')})").alias("m")
        )
        base = start.select("host", "kind", F.expr(f"greatest(1, {whole(f'{100 - damping} * seed', 100)})").alias("m"))
        rank = gain.unionAll(base).groupBy("host", "kind").agg(F.sum("m").alias("m"))
        done += 1
        if done % 4:
            continue
        rank = stash(rank, "rank")
        if last is not None:
            settled = done >= rounds and not moved(last, rank, noise)
            unstash(last)
            if settled:
                break
            if done >= MOST:
                raise RuntimeError(f"masses haven't settled after {done} rounds")
        last = rank
    return rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("m")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("m")).otherwise(0)).alias("distrust"),
    ), fine


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: int = 85,
    rounds: int = 8,
    threshold: int = 50,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust.

    rules: a short list of (verdict, host, path); it becomes one expression. Pages that a rule
    allows make their host a trusted seed and pages that a rule blocks a blocked one, each in
    proportion to its pages, both MASS in all. Where hosts link to others a unit of it has FINE parts;
    verdicts rest on parts, the two columns are in units, rounded down. Personalised PageRank spreads trust along
    host links, and its reverse spreads distrust against them, with `damping` per cent, in at
    least `rounds` rounds and until masses have settled, however far hosts are from the seeds. A host is blocked when its distrust is more than `threshold` per cent of the two summed;
    that is the verdict of pages without a rule. Hosts that nothing reaches are allowed.

    Host pairs are distinct before the loop, so it handles hosts, not pages. Null urls and urls
    without '://' have an empty host, which has no edges and no seed: they're allowed. Null html
    has no links. Repeated rows stay and count. Other columns are ignored; empty in, empty out.
    """
    for verdict, host, _ in rules:
        if verdict not in ("allow", "block") or not host:
            raise ValueError("a rule is (allow or block, host, path)")
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host, path = split_url(url)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    judged = rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    counts = judged.filter("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")
    )
    counts = stash(counts.filter("good + bad > 0"), "hosts")
    known, fine = spread(host_edges(rows), counts, damping, rounds)
    blocked = F.expr(f"100 * distrust > {threshold} * (trust + distrust)")
    known = known.select(F.col("host").alias("known"), blocked.alias("blocked"), *[F.expr(whole(x, fine)).cast("long").alias(x) for x in ("trust", "distrust")])
    out = judged.join(known, F.col("host") == F.col("known"), "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).cast("long").alias("trust"),
        F.coalesce("distrust", F.lit(0)).cast("long").alias("distrust"),
    )


def oracle(rules: list[tuple[str, str, str]], damping: int = 85, rounds: int = 8, threshold: int = 50) -> str:
    """DuckDB SQL of url_filter over `pages`: the same rounds, written out one by one.

    It counts in units only and stops after them, so it holds where masses
    stay on their hosts, as in the given pages. It finds quoted links without '>' only.
    """
    cases = "".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v} {h}{p}' "
        for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    )
    low = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"
    steps = "".join(
        f""", r{i + 1} as materialized (select host, kind, cast(sum(m) as bigint) m from (
          select b host, f.kind, ({damping} * m) // (100 * deg) m from flow f join r{i} r on f.a = r.host and f.kind = r.kind
          union all select host, kind, ({100 - damping} * seed) // 100 from start) group by all)"""
        for i in range(rounds)
    )
    return f"""
    with u as (select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
    h as (select page_id, html, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
    j as materialized (select *, case {cases} end r from h),
    c as (select host, count(*) filter (r like 'allow %') g, count(*) filter (r like 'block %') b from j where host <> '' group by host),
    t as (select greatest(1, sum(g))::bigint g, greatest(1, sum(b))::bigint b from c),
    start as materialized (
      select host, 0 kind, ({MASS} * c.g) // t.g seed from c, t where c.g > 0
      union all select host, 1, ({MASS} * c.b) // t.b from c, t where c.b > 0),
    l as (select host, unnest(regexp_extract_all(coalesce(html, ''), '{SQL_LINK.replace("'", "''")}', 1)) x from j where host <> ''),
    e as (select distinct host src, case when regexp_matches(x, '^(?:[hH][tT][tT][pP][sS]?:)?//') then {low.format("regexp_extract(x, '//([^/?#]*)', 1)")}
        when regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then '' else host end dst from l),
    both_ as (select src a, dst b, 0 kind from e where dst <> '' union all select dst, src, 1 from e where dst <> ''),
    flow as materialized (select *, count(*) over (partition by a, kind) deg from both_),
    r0 as (select host, kind, seed m from start){steps},
    k as (select host, coalesce(sum(m) filter (kind = 0), 0)::bigint trust, coalesce(sum(m) filter (kind = 1), 0)::bigint distrust from r{rounds} group by host)
    select page_id, j.host, path, substr(r, 7) as rule,
      case when r is not null then split_part(r, ' ', 1) when 100 * distrust > {threshold} * (trust + distrust) then 'block' else 'allow' end as verdict,
      coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust
    from j left join k on j.host = k.host"""
