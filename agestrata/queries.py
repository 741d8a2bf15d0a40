"""Registered queries over the star-schema fixture, each with SQL of the same result."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from agestrata.config import CATEGORIES, DEFAULT, EVENT_TYPES, TAXONOMIES, Settings
from agestrata.functions.lineage import shared_dir, written
from agestrata.functions.temporal import anchors, midnight, quarter_ends, snapshot_dates
from agestrata.operators import attract, balance, checks, figures, identity, projection, sensitivity, spans, state
from agestrata.sources import base
from agestrata.plans import stages
from agestrata.plans.store import Store
from agestrata.sources.relational import RelationalSource, commits_by_scope, jdbc
from agestrata.sources.star import StarSource
from agestrata.streaming.spans import click_events, session_spans

DATES = quarter_ends(DEFAULT.start, DEFAULT.end, DEFAULT.freq_months)
THREE = anchors(DATES)
LAST = THREE[2]
YEAR_AGO = DATES[-5]


def _src(spark, d, settings: Settings = DEFAULT, scope: str = "nation") -> StarSource:
    return StarSource(settings, spark=spark, path=d, scope=scope)


def _events(spark, d, settings: Settings = DEFAULT, scope: str = "nation"):
    return _src(spark, d, settings, scope).events()


def _spans(spark, d, settings: Settings = DEFAULT, scope: str = "nation"):
    source = _src(spark, d, settings, scope)
    return spans.activity_spans(source.events(), settings, source.tasks())


def _state(spark, d, dates=None, settings: Settings = DEFAULT, scope: str = "nation"):
    return state.state_at(_spans(spark, d, settings, scope), dates or DATES, settings)


def _annual(spark, d, settings: Settings = DEFAULT, **how):
    return attract.annual(attract.dev_years(_events(spark, d, settings)), settings, **how)


def _three(spark, d, settings: Settings = DEFAULT):
    """State at the anchors, stored: eligibility, counts, bands and types all start from it."""
    return written(_state(spark, d, list(THREE), settings), "state")


def _projected(spark, d, settings: Settings = DEFAULT):
    at = _three(spark, d, settings)
    return projection.cohort_projection(projection.band_vectors(at, THREE, settings))


def _errors(spark, d, settings: Settings = DEFAULT):
    at = _three(spark, d, settings)
    types = balance.metrics(at.filter(F.col("snapshot") == midnight(LAST)))
    return projection.errors(projection.cohort_projection(projection.band_vectors(at, THREE, settings)), types)


# ---- relational fixtures, by rules that SQL below repeats ----


def _users(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.when(k % 5 == 0, None).when(k % 11 == 0, F.lit("nobody")).otherwise(F.concat(F.lit(" U"), (k % 400).cast("string"), F.lit("@Example.org "))).alias("email"),
        F.when(k % 7 == 0, F.lit("System  Administrator")).when(k % 13 == 0, F.lit("tim")).otherwise(F.concat(F.lit("Ann  B"), F.floor(k / 3).cast("string"))).alias("name"),
    )


USERS_SQL = """users as (select c_custkey as id,
 case when c_custkey % 5 = 0 then null when c_custkey % 11 = 0 then 'nobody' else ' U' || (c_custkey % 400) || '@Example.org ' end as email,
 case when c_custkey % 7 = 0 then 'System  Administrator' when c_custkey % 13 = 0 then 'tim' else 'Ann  B' || (c_custkey // 3) end as name from customer)"""


def _identity_sql(mode: str) -> str:
    names = "" if mode == "email" else " union all select id, 'n:' || regexp_replace(trim(lower(name)), '\\s+', ' ', 'g') from users where regexp_replace(trim(lower(name)), '\\s+', ' ', 'g') like '% %' and regexp_replace(trim(lower(name)), '\\s+', ' ', 'g') <> 'system administrator'"
    return f"""with recursive {USERS_SQL},
keyed as (select id, 'e:' || trim(lower(email)) as key from users where trim(lower(email)) like '_%@%'{names}),
pairs as (select distinct a.id as a, b.id as b from keyed a join keyed b on a.key = b.key),
reach(id, r) as (select a, b from pairs union select reach.id, pairs.b from reach join pairs on reach.r = pairs.a)
select id, min(r) as canonical from reach group by id having min(r) <> id"""


def _families(spark, d):
    def table(name):
        if name == "projects":
            k = F.col("s_suppkey")
            return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), F.when(k % 3 != 0, None).otherwise(k - 1).alias("forked_from"))
        if name == "commits":
            o = spark.read.parquet(f"{d}/orders.parquet")
            return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderkey") % 10 + 1).alias("project_id"))
        return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("commit_id"))

    return table


FAMILY_SQL = """projects as (select s_suppkey as id, case when s_suppkey % 3 <> 0 then null else s_suppkey - 1 end as forked_from from supplier),
commits as (select o_orderkey as id, o_custkey as author_id, o_orderdate as created_at, o_orderkey % 10 + 1 as project_id from orders),
project_commits as (select l_suppkey as project_id, l_orderkey as commit_id from lineitem)"""
_FAMILY = {
    "root": "select project_id as scope_id, count(*) as commits, count(distinct author_id) as authors from commits group by 1",
    "family_project_id": "select coalesce(p.forked_from, p.id) as scope_id, count(*) as commits, count(distinct author_id) as authors from commits c join projects p on p.id = c.project_id group by 1",
    "family_project_commits": "select scope_id, count(*) as commits, count(distinct author_id) as authors from (select distinct coalesce(p.forked_from, p.id) as scope_id, commit_id from project_commits l join projects p on p.id = l.project_id) f join commits c on c.id = f.commit_id group by 1",
}


def _commit_scope(mode):
    def q(spark, d):
        return commits_by_scope(_families(spark, d), mode).groupBy("scope_id").agg(F.count("*").alias("commits"), F.countDistinct("author_id").alias("authors"))

    return q


#: Tables of a hosting service from the star schema: rows of line items by line number, people by part.
_WHO, _LINES = "nullif(l_partkey % 100 + 1, 50)", {
    "pull_requests": (1, "l_orderkey as id, l_suppkey as base_repo_id, {who} as user_id"),
    "pull_request_history": (1, "l_orderkey as pull_request_id, case when l_returnflag = 'R' then 'closed' else 'opened' end as action, cast(l_shipdate as timestamp) as created_at"),
    "commit_comments": (2, "l_orderkey as commit_id, {who} as user_id, cast(l_shipdate as timestamp) + interval '5' day as created_at"),
    "issues": (3, "l_orderkey as id, l_suppkey as repo_id, {who} as reporter_id, cast(l_shipdate as timestamp) as created_at"),
    "issue_comments": (4, "l_orderkey as issue_id, {who} as user_id, cast(l_shipdate as timestamp) + interval '9' day as created_at"),
    "pull_request_comments": (5, "l_orderkey as pull_request_id, {who} as user_id, cast(l_shipdate as timestamp) + interval '9' day as created_at"),
    "issue_events": (6, "l_orderkey as issue_id, {who} as actor_id, cast(l_shipdate as timestamp) + interval '5' day as created_at"),
}
_PROJECTS = "s_suppkey as id, case when s_suppkey % 3 = 0 then s_suppkey - 1 end as forked_from, s_nationkey + 1 as owner_id, s_name as name, case when s_suppkey % 4 = 0 then '' else concat('L', cast(s_nationkey as string)) end as language, timestamp '1995-01-01 00:00:00' as created_at"


def _hosting(spark, d):
    """The tables of the relational adapter."""
    older = _families(spark, d)

    def table(name):
        if name == "users":
            return _users(spark, d).join(spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as id", "c_name as login"), "id")
        if name == "projects":
            return spark.read.parquet(f"{d}/supplier.parquet").selectExpr(*_columns(_PROJECTS))
        if name in _LINES:
            line, columns = _LINES[name]
            return spark.read.parquet(f"{d}/lineitem.parquet").filter(F.col("l_linenumber") == line).selectExpr(*_columns(columns.format(who=_WHO)))
        return older(name)

    return table


def _columns(text: str) -> list[str]:
    """Columns of a select list: commas inside brackets don't part them."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _hosting_sql() -> str:
    lines = ", ".join(f"{n} as (select {c.format(who=_WHO)} from lineitem where l_linenumber = {k})" for n, (k, c) in _LINES.items())
    return f"""{USERS_SQL}, logins as (select c_custkey as id, c_name as login from customer), projects as (select {_PROJECTS} from supplier),
{FAMILY_SQL[FAMILY_SQL.index("commits as"):]}, {lines},
rscopes as (select p.id as scope_id, login || '/' || name as label, nullif(language, '') as language, created_at from projects p join logins u on u.id = owner_id where forked_from is null)"""


_COMMITS = {
    "root": "select project_id as scope_id, author_id, created_at from commits",
    "family_project_commits": "select scope_id, author_id, created_at from (select distinct coalesce(p.forked_from, p.id) as scope_id, commit_id from project_commits l join projects p on p.id = l.project_id) f join commits c on c.id = f.commit_id",
}


def _relational_sql(taxonomy: str, mode: str) -> str:
    arms = {
        "commits": f"select scope_id, author_id as who, created_at as ts from ({_COMMITS[mode]}) x",
        "pull_requests": "select base_repo_id, user_id, h.created_at from pull_requests p join pull_request_history h on h.pull_request_id = p.id where action = 'opened'",
        "commit_comments": "select project_id, user_id, k.created_at from commit_comments k join commits c on c.id = commit_id",
        "issues": "select repo_id, reporter_id, created_at from issues",
        "issue_comments": "select repo_id, user_id, k.created_at from issue_comments k join issues i on i.id = issue_id",
        "pull_request_comments": "select base_repo_id, k.user_id, k.created_at from pull_request_comments k join pull_requests p on p.id = pull_request_id",
        "issue_events": "select repo_id, actor_id, k.created_at from issue_events k join issues i on i.id = issue_id",
    }
    union = " union all ".join(f"select cast(scope_id as bigint) as scope_id, cast(who as bigint) as contributor_id, '{t}' as event_type, cast(ts as timestamp) as timestamp from ({arms[t]}) a(scope_id, who, ts)" for t in TAXONOMIES[taxonomy].active)
    return f"rel as (select * from ({union}) where contributor_id is not null and timestamp is not null and scope_id in (select scope_id from rscopes))"


def _relational(spark, d, taxonomy: str, mode: str, merge: str = "none") -> RelationalSource:
    return RelationalSource(DEFAULT.but(taxonomy=taxonomy), table=_hosting(spark, d), commit_scope=mode, identity_merge=merge)


#: A database inside Spark's own JVM, whose driver comes with Spark.
_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
#: The columns by whose ranges the larger tables of the database are read.
JDBC_KEYS = {"commits": "id", "pull_requests": "id", "pull_request_history": "pull_request_id", "issues": "id", "issue_events": "issue_id"}


def _in_database(spark, d, taxonomy: str):
    """A reader of the hosting tables in a database of their own, loaded with all rows of those that a taxonomy needs. On
    a cluster, where other machines can't see a database inside the driver's JVM, the tables themselves are read."""
    table = _hosting(spark, d)
    if not spark.sparkContext.master.startswith("local["):
        return table
    url = f"jdbc:derby:memory:agestrata{uuid.uuid4().hex}"
    parents = {"commit_comments": "commits", "issue_comments": "issues", "issue_events": "issues", "pull_request_comments": "pull_requests", "pull_requests": "pull_request_history"}
    needed = {"projects", "users", *TAXONOMIES[taxonomy].active}
    needed |= {parents[t] for t in needed if t in parents} | {"pull_request_history"}
    for k, name in enumerate(sorted(needed)):
        df = table(name)
        options = {"driver": _DERBY, "batchsize": "5000"}
        if "action" in df.columns:  # it is compared, which this database can't do with the large objects it has for texts
            options["createTableColumnTypes"] = "action varchar(20)"
        df.repartition(4).write.jdbc(f"{url};create=true" if not k else url, name, "append", options)
    return jdbc(spark, url, JDBC_KEYS, 4, driver=_DERBY)


def _jdbc_events(spark, d, taxonomy: str = "prose"):
    return RelationalSource(DEFAULT.but(taxonomy=taxonomy), table=_in_database(spark, d, taxonomy)).events()


_NAME = "regexp_replace(trim(lower(name)), '\\s+', ' ', 'g')"
MERGED_SQL = f"""people as (select distinct scope_id, contributor_id as id from rel),
keys0 as (select id, 'e:' || trim(lower(email)) as key from users where trim(lower(email)) like '_%@%' union all select id, 'n:' || {_NAME} from users where {_NAME} like '% %' and {_NAME} <> 'system administrator'),
keyed as (select scope_id, p.id, key from people p join keys0 k on k.id = p.id),
pairs as (select distinct a.scope_id, a.id as a, b.id as b from keyed a join keyed b on a.key = b.key and a.scope_id = b.scope_id),
reach(scope_id, id, r) as (select scope_id, a, b from pairs union select reach.scope_id, reach.id, pairs.b from reach join pairs on reach.r = pairs.a and reach.scope_id = pairs.scope_id),
least as (select scope_id, id, min(r) as canonical from reach group by 1, 2)"""


# ---- stage tables ----


def _stored(spark, d, name: str):
    """A stage table after a run of all stages into a store of its own."""
    store = Store(spark, f"{shared_dir(spark)}/agestrata-store-{uuid.uuid4().hex}")
    stages.run(store, _src(spark, d), DEFAULT)
    return store.read(name)


def _late_spans(spark, d):
    """Spans of two thirds of all events, into which the last third is taken."""
    events = _events(spark, d)
    late = F.pmod(F.xxhash64(*events.columns), F.lit(3)) == 0
    early = written(spans.activity_spans(events.filter(~late)), "early-spans")
    made = written(spans.with_late(early, events.filter(late)), "late-spans")
    return made.unionByName(early.join(made.select(*spans.KEY).distinct(), list(spans.KEY), "left_anti"))


# ---- SQL blocks ----


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def ev_sql(taxonomy: str = "prose", scope: str = "nation") -> str:
    of = {"nation": "s_nationkey", "supplier": "l_suppkey", "region": "n_regionkey"}[scope]
    kinds = "case l_linenumber " + " ".join(f"when {k + 1} then '{t}'" for k, t in enumerate(EVENT_TYPES)) + " end"
    return f"""ev0 as (select cast({of} as bigint) as scope_id, o_custkey as contributor_id, {kinds} as event_type, cast(l_shipdate as timestamp) as ts
 from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
ev as (select * from ev0 where event_type in {_in(TAXONOMIES[taxonomy].active)})"""


SCOPES_SQL = "scopes as (select cast(n_nationkey as bigint) as scope_id, r_name || '/' || n_name as label, r_name as language from nation join region on n_regionkey = r_regionkey)"
COD = _in(TAXONOMIES["prose"].coding)
SPANS_SQL = f"""fi as (select scope_id, contributor_id, min(case when event_type in {COD} then ts end) as init_c, min(case when event_type not in {COD} then ts end) as init_d from ev group by 1, 2),
gp as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by scope_id, contributor_id order by ts)) > {DEFAULT.gap_us} then 1 else 0 end as brk from ev),
isl as (select *, sum(brk) over (partition by scope_id, contributor_id order by ts rows unbounded preceding) as k from gp),
sp0 as (select scope_id, contributor_id, min(ts) as span_start, max(ts) as span_end, cast(k as integer) as span_idx from isl group by scope_id, contributor_id, k),
spans as (select sp0.*, init_c, init_d from sp0 join fi using (scope_id, contributor_id))"""


def dates_sql(dates) -> str:
    return "dates as (select unnest([" + ", ".join(f"timestamp '{d} 00:00:00'" for d in dates) + "]) as snapshot)"


def state_sql(dates, basis: str = "calendar_tenure") -> str:
    age = "(epoch_us(snapshot) - epoch_us(origin)) / 86400000000.0" if basis == "calendar_tenure" else "worked"
    return f"""{dates_sql(dates)},
vis as (select s.*, snapshot, init_c is not null and init_c <= snapshot as coded, case when init_c is not null and init_c <= snapshot then init_c else init_d end as origin from spans s join dates on span_start <= snapshot),
per as (select scope_id, contributor_id, snapshot, coded, origin, init_c, init_d, max(least(span_end, snapshot)) as last,
 sum(greatest((epoch_us(least(span_end, snapshot)) - epoch_us(greatest(span_start, origin))) / 86400000000.0, 0.0)) as worked from vis group by all),
ag as (select *, greatest({age}, 0.0) as age_days, (epoch_us(snapshot) - epoch_us(last)) / 86400000000.0 as idle_days from per),
state as (select scope_id, snapshot, contributor_id, case when coded and init_d < init_c then 'moved' when coded then 'coding' else 'non_coding' end as category,
 age_days, age_days / 30.4375 as age_months, cast(greatest(ceil(round(age_days / 90.0, 9)) - 1, 0) as integer) as band, idle_days, idle_days <= 91.3125 as active from ag)"""


METRICS_SQL = """m0 as (select scope_id, snapshot, count(*) filter (category <> 'non_coding') as coding, count(*) filter (category = 'non_coding') as non_coding,
 count(*) filter (band = 0) as new, count(*) filter (band > 0) as experienced, count(*) as total from state where active group by 1, 2),
m1 as (select *, (coding - non_coding) / nullif(greatest(coding, non_coding), 0) as ccr, (new - experienced) / nullif(greatest(new, experienced), 0) as ncr from m0),
metrics as (select *, case when ccr is null or ncr is null then null when ccr > 0 and ncr > 0 then 'A' when ncr > 0 then 'B' when ccr > 0 then 'C' else 'D' end as type from m1)"""


def pyramid_sql(where: str) -> str:
    return f"""pc as (select scope_id, snapshot, band, {", ".join(f"count(*) filter (category = '{c}') as {c}" for c in CATEGORIES)} from state where {where} group by 1, 2, 3),
pt as (select scope_id, snapshot, unnest(range(max(band) + 1)) as band from pc group by 1, 2),
pyr as (select pt.scope_id, pt.snapshot, cast(pt.band as integer) as band, {", ".join(f"coalesce({c}, 0) as {c}" for c in CATEGORIES)} from pt left join pc on pt.scope_id = pc.scope_id and pt.snapshot = pc.snapshot and pt.band = pc.band)"""


def pairs_sql(name: str = "pairs", types: str = f"event_type in {COD}") -> str:
    return f"{name} as (select distinct scope_id, contributor_id, cast(year(ts) as integer) as year from ev where {types})"


def annual_sql(pairs: str = "pairs", debut: str = "", local: bool = False, least: int = 10, sticky: str = "project", ties: str = ">") -> str:
    first = debut or f"select contributor_id, min(year) as first_year from {pairs} group by 1"
    new = f"p.year = min(p.year) over (partition by p.scope_id, p.contributor_id)" if local else "coalesce(p.year = f.first_year, false)"
    who = "(scope_id, contributor_id)" if local else "contributor_id"
    stay = f"exists (select 1 from {pairs} q where q.contributor_id = p.contributor_id and q.year = p.year + 1{' and q.scope_id = p.scope_id' if sticky == 'project' else ''})"
    high = lambda c: f"{c} {ties} median_{c}"
    return f"""fy as ({first}),
nw as (select p.*, {new} as is_new, {stay} as stayed from {pairs} p left join fy f on f.contributor_id = p.contributor_id),
a0 as (select scope_id, year, count(*) as devs, count(*) filter (is_new) as newcomers_here, count(*) filter (stayed) as retained from nw group by 1, 2),
nt as (select year, count(distinct {who}) as newcomers_total from nw where is_new group by 1),
a1 as (select a0.*, coalesce(newcomers_total, 0) as newcomers_total, a0.year = (select min(year) from {pairs}) as left_censored, a0.year = (select max(year) from {pairs}) as right_censored from a0 left join nt on nt.year = a0.year),
a2 as (select *, newcomers_here / nullif(newcomers_total, 0) as magnetism, case when not right_censored then retained / nullif(devs, 0) end as stickiness from a1),
a3 as (select *, devs > {least} and magnetism is not null and stickiness is not null as eligible from a2),
md as (select year, median(magnetism) as median_magnetism, median(stickiness) as median_stickiness from a3 where eligible group by 1),
annual as (select scope_id, a3.year, devs, newcomers_here, newcomers_total, retained, magnetism, stickiness, eligible, median_magnetism, median_stickiness,
 case when not eligible then null when {high("magnetism")} and {high("stickiness")} then 'attractive' when {high("magnetism")} then 'floating' when {high("stickiness")} then 'stagnant' else 'terminal' end as quadrant,
 left_censored, right_censored from a3 left join md on md.year = a3.year)"""


def projection_sql(least: int = 50, basis: str = "active") -> str:
    b, l, t = (f"timestamp '{x} 00:00:00'" for x in THREE)
    return f"""el as (select scope_id, count(distinct contributor_id) as contributors from state where snapshot = {b}{' and active' if basis == 'active' else ''} group by 1 having count(distinct contributor_id) > {least}),
ct as (select scope_id, category, band, count(*) filter (snapshot = {b}) as base, count(*) filter (snapshot = {l}) as last, count(*) filter (snapshot = {t}) as actual from state where active group by 1, 2, 3),
ca as (select * from ct union all select scope_id, 'all', band, sum(base), sum(last), sum(actual) from ct group by 1, 3),
sn as (select scope_id, category, unnest(range((select max(band) + 1 from state))) as band from el, (values ('non_coding'), ('moved'), ('coding'), ('all')) c(category)),
vectors as (select sn.scope_id, sn.category, cast(sn.band as integer) as band, cast(coalesce(base, 0) as double) as base, cast(coalesce(last, 0) as double) as last, cast(coalesce(actual, 0) as double) as actual
 from sn left join ca on sn.scope_id = ca.scope_id and sn.category = ca.category and sn.band = ca.band),
p0 as (select *, lag(base) over w as pb, lag(last) over w as pl from vectors window w as (partition by scope_id, category order by band)),
projected as (select scope_id, category, band, base, last, actual, band > 0 and pb = 0 and last > 0 as orphan,
 case when band = 0 then (last + base) / 2 when pb = 0 and last > 0 then null when pb = 0 then 0.0 else last / nullif(pb, 0) * pl end as cohort_pred from p0),
errs as (select p.scope_id, m.type, category, band, actual, cohort_pred, last as baseline_pred,
 case when cohort_pred is not null then abs(cohort_pred - actual) / nullif(least(actual, cohort_pred), 0) end as abre_cohort, abs(last - actual) / nullif(least(actual, last), 0) as abre_baseline
 from projected p left join (select scope_id, type from metrics where snapshot = {t}) m on m.scope_id = p.scope_id where not (actual = 0 or (coalesce(cohort_pred = 0, false) and last = 0))),
comp as (select * from errs where abre_cohort is not null and abre_baseline is not null),
typed as (select * exclude (type), type from comp where type is not null union all select * exclude (type), 'All types' from comp)"""


MEDIANS_SQL = ", ".join(f"median(abre_{m}) filter (category = '{c}') as {c}_{m}" for c in projection.SERIES for m in ("cohort", "baseline"))
ERROR_TABLE_SQL = f"select type, count(distinct scope_id) as projects, count(*) filter (category = 'all') as pairs, {MEDIANS_SQL} from typed group by 1"
STATE = f"{ev_sql()}, {SPANS_SQL}, {state_sql(DATES)}"
STATE3 = f"{ev_sql()}, {SPANS_SQL}, {state_sql(THREE)}, {METRICS_SQL}"
PROJ = f"{STATE3}, {projection_sql()}"
ANNUAL = f"{ev_sql()}, {pairs_sql()}, {annual_sql()}"
TERMS_SQL = f"""{PROJ}, v as (select abre_cohort as x, band < 4 as short from errs where category = 'all' and abre_cohort is not null),
rk as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as r from v),
g as (select median(x) filter (short) as short_median, median(x) filter (not short) as long_median, count(*) filter (short) as short_n, count(*) filter (not short) as long_n, sum(r) filter (short) as r1 from rk),
terms as (select short_median, long_median, short_n, long_n, r1, case when short_n > 0 and long_n > 0 then (r1 - short_n * (short_n + long_n + 1) / 2) / sqrt(cast(short_n as double) * long_n * (short_n + long_n + 1) / 12) end as z from g)"""
LAST_SQL = f"timestamp '{LAST} 00:00:00'"


def tail_sql(z: str) -> str:
    """P(|Z| >= |z|) of a standard normal Z, its density summed by Simpson's rule."""
    return f"greatest(0, 1 - 2 * (select sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-(({z} * i / 4000) ** 2) / 2)) from range(4001) r(i)) * abs({z}) / 12000 / sqrt(2 * pi()))"


WILCOXON_SQL = """df as (select type, category, abre_cohort - abre_baseline as d, abs(abre_cohort - abre_baseline) > 1e-8 + 1e-5 * abs(abre_baseline) as far from typed),
rk as (select type, category, d, rank() over (partition by type, category order by abs(d)) + (count(*) over (partition by type, category, abs(d)) - 1) / 2 as r, count(*) over (partition by type, category, abs(d)) as t from df where d <> 0),
al as (select type, category, count(*) filter (d = 0) as zeros, count(*) filter (far) as far from df group by 1, 2),
stat as (select al.type, al.category, count(r) as n, zeros, coalesce(sum(r) filter (d > 0), 0.0) as w_plus, coalesce(sum(r) filter (d < 0), 0.0) as w_minus, coalesce(sum(cast(t * t - 1 as double)), 0.0) as ties, far
 from al left join rk on al.type = rk.type and al.category = rk.category group by al.type, al.category, zeros, far)"""


def _wilcoxon_p_sql(exact: str, beyond: str = tail_sql("z")) -> str:
    """Signs are tried rank by rank: each sum of ranks so far, with the share of signs that give it."""
    return f"""with recursive {PROJ}, {WILCOXON_SQL},
sized as (select *, least(w_plus, w_minus) as w, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 as spread, {exact} as exact from stat where n > 0 and far > 0),
zs as (select *, case when spread > 0 then abs(w - n * (n + 1) / 4) / sqrt(spread) end as z from sized),
steps as (select rk.type, rk.category, cast(2 * r as integer) as r, cast(2 * w as integer) as w, row_number() over (partition by rk.type, rk.category order by r) as k from rk join sized on rk.type = sized.type and rk.category = sized.category where exact),
dist(type, category, k, s, share) as (select distinct type, category, cast(0 as bigint), 0, cast(1 as double) from steps union all
 select d.type, d.category, st.k, d.s + st.r * u.x, sum(d.share) / 2 from dist d join steps st on st.type = d.type and st.category = d.category and st.k = d.k + 1, (values (0), (1)) u(x)
 where d.s + st.r * u.x <= st.w group by all),
ends as (select dist.type, dist.category, least(1, 2 * sum(share)) as p from dist join sized on sized.type = dist.type and sized.category = dist.category and dist.k = n group by all)
select stat.type, stat.category, round(case when exact then ends.p when z is not null then {beyond} end, 9) as p
from stat left join zs on zs.type = stat.type and zs.category = stat.category left join ends on ends.type = stat.type and ends.category = stat.category"""

# Expected medians for the cell checks.
EXPECTED = [("All types", "all", 0.4, 0.5), ("All types", "coding", 0.5, 0.5), ("C", "all", 0.35, 0.4), ("C", "non_coding", 0.0, 0.2), ("B", "moved", 0.6, 0.5)]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


add("events_canonical", lambda s, d: _events(s, d), f"with {ev_sql()} select scope_id, contributor_id, event_type, ts as timestamp from ev")
add("scope_summary", lambda s, d: spans.scope_summary(_events(s, d)), f"with {ev_sql()} select scope_id, count(*) as events, count(distinct contributor_id) as contributors, min(ts) as first, max(ts) as last from ev group by 1")
add("contract_violations", lambda s, d: base.violations(_events(s, d, DEFAULT.but(taxonomy="union")), midnight(date(2000, 1, 1))),
    f"with {ev_sql('union')} select 'null_contributor' as rule, count(*) filter (contributor_id is null) as rows from ev union all select 'null_timestamp', count(*) filter (ts is null) from ev union all select 'unknown_type', 0 union all select 'future_timestamp', count(*) filter (ts > timestamp '2000-01-01') from ev")
for _t in TAXONOMIES:
    add(f"side_counts_{_t}", lambda s, d, t=_t: spans.side_counts(_events(s, d, DEFAULT.but(taxonomy=t)), DEFAULT.but(taxonomy=t)), f"with {ev_sql(_t)} select scope_id, count(*) filter (event_type in {COD}) as coding, count(*) filter (event_type not in {COD}) as non_coding from ev group by 1")
for _m in ("email", "email_name"):
    add(f"identity_{_m}", lambda s, d, m=_m: identity.alias_map(_users(s, d), m), _identity_sql(_m))
for _m, _q in _FAMILY.items():
    add(f"commit_scope_{_m}", _commit_scope(_m), f"with {FAMILY_SQL} {_q}")
add("relational_scopes", lambda s, d: _relational(s, d, "union", "root").scopes(), f"with {_hosting_sql()} select scope_id, label, language, created_at from rscopes")
for _n, _t, _m in (("relational_events", "union", "root"), ("relational_events_family", "prose", "family_project_commits")):
    add(_n, lambda s, d, t=_t, m=_m: _relational(s, d, t, m).events(), f"with {_hosting_sql()}, {_relational_sql(_t, _m)} select * from rel")
add("jdbc_events", _jdbc_events, f"with {_hosting_sql()}, {_relational_sql('prose', 'root')} select * from rel")
add("merged_events", lambda s, d: _relational(s, d, "prose", "root", "email_name").events(),
    f"with recursive {_hosting_sql()}, {_relational_sql('prose', 'root')}, {MERGED_SQL} select rel.scope_id, coalesce(canonical, contributor_id) as contributor_id, event_type, timestamp from rel left join least on least.scope_id = rel.scope_id and least.id = rel.contributor_id")
add("relational_projects", lambda s, d: _relational(s, d, "prose", "root").projects([2, 3, 5]), f"with {_hosting_sql()} select p.id, login as owner, name, language, created_at, forked_from from projects p join logins u on u.id = owner_id where p.id in (2, 3, 5)")
add("firsts", lambda s, d: spans.firsts(_events(s, d)), f"with {ev_sql()}, {SPANS_SQL} select * from fi")
for _sc in ("nation", "region", "supplier"):
    add("activity_spans" + ("" if _sc == "nation" else f"_{_sc}"), lambda s, d, sc=_sc: _spans(s, d, scope=sc), f"with {ev_sql(scope=_sc)}, {SPANS_SQL} select scope_id, contributor_id, span_start, span_end, span_idx, init_c, init_d from spans")
add("late_spans", _late_spans, f"with {ev_sql()}, {SPANS_SQL} select scope_id, contributor_id, span_start, span_end, span_idx, init_c, init_d from spans")
add("span_summary", lambda s, d: spans.span_summary(_spans(s, d)), f"with {ev_sql()}, {SPANS_SQL} select scope_id, count(distinct contributor_id) as contributors, count(distinct case when init_c is not null then contributor_id end) as ever_coded, count(*) as spans, count(*) filter (span_idx > 0) as later_spans from spans group by 1")
add("snapshot_dates", lambda s, d: snapshot_dates(s, DEFAULT.start, DEFAULT.end), "select cast(last_day(x) as timestamp) as snapshot from (select unnest(generate_series(date '1995-03-01', date '2001-09-01', interval 3 month)) as x)")
add("state_at_snapshot", lambda s, d: _state(s, d), f"with {STATE} select * from state")
add("state_accumulated_age", lambda s, d: _state(s, d, [DATES[10], LAST], DEFAULT.but(age_basis="accumulated_active")).withColumns({c: F.round(c, 6) for c in ("age_days", "age_months")}), f"with {ev_sql()}, {SPANS_SQL}, {state_sql([DATES[10], LAST], 'accumulated_active')} select * replace (round(age_days, 6) as age_days, round(age_months, 6) as age_months) from state")
add("pyramid_active12m", lambda s, d: balance.pyramid(_state(s, d)), f"with {STATE}, {pyramid_sql('idle_days <= 365.25')} select * from pyr")
add("pyramid_stock", lambda s, d: balance.pyramid(_state(s, d), DEFAULT.but(pyramid_population="stock")), f"with {STATE}, {pyramid_sql('true')} select * from pyr")
add("balance_metrics", lambda s, d: balance.metrics(_state(s, d)), f"with {STATE}, {METRICS_SQL} select scope_id, snapshot, coding, non_coding, new, experienced, total, ccr, ncr, type from metrics")
add("balance_metrics_supplier", lambda s, d: balance.metrics(_state(s, d, scope="supplier")), f"with {ev_sql(scope='supplier')}, {SPANS_SQL}, {state_sql(DATES)}, {METRICS_SQL} select scope_id, snapshot, coding, non_coding, new, experienced, total, ccr, ncr, type from metrics")
add("type_table", lambda s, d: balance.type_table(balance.metrics(_state(s, d, [LAST])), _src(s, d).scopes(), LAST), f"with {STATE}, {METRICS_SQL}, {SCOPES_SQL} select m.scope_id, label, coding, non_coding, new, experienced, total, ccr, ncr, type from metrics m left join scopes using (scope_id) where snapshot = {LAST_SQL}")
add("type_counts", lambda s, d: balance.type_counts(balance.metrics(_state(s, d, [LAST])), _src(s, d).scopes(), LAST), f"with {STATE}, {METRICS_SQL}, {SCOPES_SQL} select coalesce(type, 'unclassified') as type, count(*) as scopes from scopes left join (select * from metrics where snapshot = {LAST_SQL}) m using (scope_id) group by 1")
add("type_scatter", lambda s, d: figures.type_scatter(balance.metrics(_state(s, d, [LAST])), _src(s, d).scopes(), LAST), f"with {STATE}, {METRICS_SQL}, {SCOPES_SQL} select m.scope_id, split_part(label, '/', -1) as short_label, ccr, ncr, type from metrics m join scopes using (scope_id) where snapshot = {LAST_SQL} and type is not null")
add("pyramid_transition", lambda s, d: figures.pyramids_of(_state(s, d), [1, 2, 3], [date(y, 6, 30) for y in range(1998, 2002)]), f"with {STATE}, {pyramid_sql('idle_days <= 365.25')} select * from pyr where scope_id in (1, 2, 3) and month(snapshot) = 6 and year(snapshot) >= 1998")
_GRID = f"with {STATE}, {METRICS_SQL}, {pyramid_sql('idle_days <= 365.25')}, p as (select * from pyr where scope_id in (1, 2, 3) and snapshot = {LAST_SQL})"
add("pyramid_grid_types", lambda s, d: figures.grid_types(at := _state(s, d, [LAST]), balance.metrics(at), [1, 2, 3], LAST), f"{_GRID} select p.*, type from p left join (select scope_id, type from metrics where snapshot = {LAST_SQL}) m using (scope_id)")
add("pyramid_grid_centered", lambda s, d: figures.grid_centered(at := _state(s, d, [LAST]), balance.metrics(at), [1, 2, 3], LAST), f"{_GRID} select p.*, ccr, ncr, type from p left join (select scope_id, ccr, ncr, type from metrics where snapshot = {LAST_SQL}) m using (scope_id)")
add("pyramid_grid_status", lambda s, d: figures.grid_status(_state(s, d, [DATES[11]]), _annual(s, d), [1, 2, 3], DATES[11]), f"with {STATE}, {pyramid_sql('idle_days <= 365.25')}, {pairs_sql()}, {annual_sql()} select pyr.*, quadrant from pyr left join (select scope_id, quadrant from annual where year = {DATES[11].year}) a using (scope_id) where scope_id in (1, 2, 3) and snapshot = timestamp '{DATES[11]}'")
add("pyramid_single", lambda s, d: figures.pyramids_of(_state(s, d, [LAST]), [2], [LAST]), f"{_GRID} select * from p where scope_id = 2")
add("last_metrics", lambda s, d: stages.last_metrics(balance.metrics(_state(s, d))), f"with {STATE}, {METRICS_SQL} select scope_id, snapshot, coding, non_coding, new, experienced, total, ccr, ncr, type from metrics qualify row_number() over (partition by scope_id order by snapshot desc) = 1")
add("balance_by_region", lambda s, d: _by_region(s, d), f"with {ev_sql(scope='region')}, {SPANS_SQL}, {state_sql([LAST])}, {METRICS_SQL} select r_name as value, coding, non_coding, new, experienced, total, ccr, ncr, type from metrics join region on r_regionkey = scope_id")
add("dev_years", lambda s, d: attract.dev_years(_events(s, d)), f"with {ev_sql()}, {pairs_sql()} select * from pairs")
add("newcomers", lambda s, d: attract.newcomers(attract.dev_years(_events(s, d))), f"with {ANNUAL} select scope_id, year, devs, newcomers_here, newcomers_total from annual")
for _k in ("project", "dataset"):
    add(f"retention_{_k}", lambda s, d, k=_k: attract.retained(attract.dev_years(_events(s, d)), k).groupBy("scope_id", "year").agg(F.count_if("stayed").alias("retained")), f"with {ev_sql()}, {pairs_sql()}, {annual_sql(sticky=_k)} select scope_id, year, retained from annual")
add("attractiveness_annual", lambda s, d: _annual(s, d), f"with {ANNUAL} select * from annual")
add("attractiveness_dataset", lambda s, d: _annual(s, d, DEFAULT.but(stickiness_scope="dataset")), f"with {ev_sql()}, {pairs_sql()}, {annual_sql(sticky='dataset')} select * from annual")
add("quadrant_counts", lambda s, d: attract.quadrant_counts(_annual(s, d)), f"with {ANNUAL} select year, quadrant, count(*) as scopes, any_value(median_magnetism) as median_magnetism, any_value(median_stickiness) as median_stickiness from annual group by 1, 2")
add("quadrant_grid", lambda s, d: attract.quadrant_grid(_annual(s, d)), f"with {ANNUAL}, g as (select scope_id, cast(unnest(range((select min(year) from annual), (select max(year) + 1 from annual))) as integer) as year from (select distinct scope_id from annual)) select g.scope_id, g.year, case when eligible is null then '-' when not eligible then '*' else upper(quadrant[1]) end as mark from g left join annual a on a.scope_id = g.scope_id and a.year = g.year")
add("quadrant_rows", lambda s, d: attract.grid_rows(attract.quadrant_grid(_annual(s, d))), f"with {ANNUAL}, g as (select scope_id, cast(unnest(range((select min(year) from annual), (select max(year) + 1 from annual))) as integer) as year from (select distinct scope_id from annual)), k as (select g.scope_id, g.year, case when eligible is null then '-' when not eligible then '*' else upper(quadrant[1]) end as mark from g left join annual a on a.scope_id = g.scope_id and a.year = g.year) select scope_id, min(year) as first, string_agg(mark, '' order by year) as marks from k group by 1")
add("magnetism_table", lambda s, d: attract.year_table(_annual(s, d), _src(s, d).scopes(), 1997), f"with {ANNUAL}, {SCOPES_SQL} select scope_id, label, quadrant, magnetism, stickiness, devs, newcomers_here from annual left join scopes using (scope_id) where year = 1997 and eligible")
add("magnet_sticky", lambda s, d: figures.magnet_sticky(_annual(s, d), _src(s, d).scopes(), 1997), f"with {ANNUAL}, {SCOPES_SQL} select scope_id, label, magnetism, stickiness, quadrant from annual join scopes using (scope_id) where year = 1997 and eligible")
add("tie_high", lambda s, d: _annual(s, d, ties="high"), f"with {ev_sql()}, {pairs_sql()}, {annual_sql(ties='>=')} select * from annual")
for _n in (5, 20):
    add(f"min_devs_{_n}", lambda s, d, n=_n: _annual(s, d, DEFAULT.but(min_active_devs=n)), f"with {ev_sql()}, {pairs_sql()}, {annual_sql(least=_n)} select * from annual")
_any = f"{ev_sql()}, {pairs_sql()}, {pairs_sql('anyp', 'true')}"
_debut = "select contributor_id, min(year) as first_year from anyp group by 1"
for _v, _sql in (("A", annual_sql()), ("B", annual_sql(debut=_debut)), ("C", annual_sql("anyp", _debut)), ("D", annual_sql(local=True))):
    add(f"newcomer_variant_{_v}", lambda s, d, v=_v: sensitivity.newcomer_variant(_events(s, d), v), f"with {_any}, {_sql} select * from annual")
add("projection_eligible", lambda s, d: projection.eligible(_state(s, d, [THREE[0]]), THREE[0]), f"with {PROJ} select scope_id, contributors from el")
add("projection_eligible_100", lambda s, d: projection.eligible(_state(s, d, [THREE[0]]), THREE[0], DEFAULT.but(min_contributors=100)), f"with {STATE3}, {projection_sql(100)} select scope_id, contributors from el")
add("projection_eligible_cumulative", lambda s, d: projection.eligible(_state(s, d, [THREE[0]]), THREE[0], DEFAULT.but(min_contributors=100, min_contributors_basis="cumulative")), f"with {STATE3}, {projection_sql(100, 'cumulative')} select scope_id, contributors from el")
add("band_vectors", lambda s, d: projection.band_vectors(_state(s, d, list(THREE)), THREE), f"with {PROJ} select * from vectors")
add("cohort_projection", lambda s, d: _projected(s, d), f"with {PROJ} select * from projected")
add("orphan_cohorts", lambda s, d: projection.orphans(_projected(s, d)), f"with {PROJ} select category, count(*) filter (orphan) as orphans from projected where category <> 'all' group by 1")
add("projection_errors", lambda s, d: _errors(s, d), f"with {PROJ} select * from errs")
add("projection_errors_100", lambda s, d: _errors(s, d, DEFAULT.but(min_contributors=100)), f"with {STATE3}, {projection_sql(100)} select * from errs")
add("projection_mre", lambda s, d: _errors(s, d).select("scope_id", "category", "band", projection.mre(F.col("actual"), F.col("cohort_pred")).alias("mre"), projection.mer(F.col("actual"), F.col("cohort_pred")).alias("mer")), f"with {PROJ} select scope_id, category, band, abs(cohort_pred - actual) / nullif(actual, 0) as mre, abs(cohort_pred - actual) / nullif(cohort_pred, 0) as mer from errs")
add("projection_overlay", lambda s, d: figures.projection_overlay(_errors(s, d), [0, 1, 2, 3, 4]), f"with {PROJ} select scope_id, category, band, actual, cohort_pred, baseline_pred from errs where scope_id < 5")
add("projection_frame", lambda s, d: figures.projection_frame(_errors(s, d), "actual"), f"with {PROJ}, t as (select scope_id, unnest(range(max(band) + 1)) as band from errs where category <> 'all' group by 1) select t.scope_id, cast(t.band as integer) as band, {', '.join(f"coalesce(sum(actual) filter (category = '{c}'), 0.0) as {c}" for c in CATEGORIES)} from t left join errs e on e.scope_id = t.scope_id and e.band = t.band and category <> 'all' group by 1, 2")
add("stored_metrics", lambda s, d: _stored(s, d, "metrics"), f"with {STATE}, {METRICS_SQL} select scope_id, snapshot, coding, non_coding, new, experienced, total, ccr, ncr, type from metrics")
add("stored_annual", lambda s, d: _stored(s, d, "annual"), f"with {ANNUAL} select * from annual")
add("stored_projection", lambda s, d: _stored(s, d, "projection"), f"with {PROJ} select * from errs")
add("abre_table", lambda s, d: projection.error_table(_errors(s, d)), f"with {PROJ} {ERROR_TABLE_SQL}")
add("wilcoxon_stat", lambda s, d: projection.signed_ranks(_errors(s, d)), f"with {PROJ}, {WILCOXON_SQL} select * from stat")
add("wilcoxon_p", lambda s, d: projection.signed_rank_table(_errors(s, d)).withColumn("p", F.round("p", 9)), _wilcoxon_p_sql("n <= 50 and zeros = 0 and ties = 0"))
add("wilcoxon_exact_p", lambda s, d: projection.signed_rank_table(_errors(s, d), "exact").withColumn("p", F.round("p", 9)), _wilcoxon_p_sql("n <= 300", beyond="null"))
add("term_split", lambda s, d: projection.term_split(_errors(s, d)).withColumn("z", F.round("z", 9)), f"with {TERMS_SQL} select * replace (round(z, 9) as z) from terms")
add("term_split_p", lambda s, d: projection.term_split_p(_errors(s, d)).withColumn("z", F.round("z", 9)).withColumn("p", F.round("p", 9)),
    f"with {TERMS_SQL} select * replace (round(z, 9) as z), round(case when z is not null then {tail_sql('z')} end, 9) as p from terms")
add("check_cells", lambda s, d: checks.check_cells(s.createDataFrame(EXPECTED, "type string, category string, cohort double, baseline double"), checks.long_error_table(projection.error_table(_errors(s, d))), 0.3),
    f"""with {PROJ}, et as ({ERROR_TABLE_SQL}), lg as ({" union all ".join(f"select type, '{c}' as category, {c}_cohort as got_cohort, {c}_baseline as got_baseline from et" for c in projection.SERIES)}),
ex(type, category, cohort, baseline) as (values {", ".join(f"('{t}', '{c}', cast({a} as double), cast({b} as double))" for t, c, a, b in EXPECTED)})
select ex.type, ex.category, cohort, baseline, got_cohort, got_baseline, coalesce(abs(got_cohort - cohort) <= 0.3 * case when cohort = 0 then 1.0::double else abs(cohort) end, false) as cohort_ok,
coalesce(abs(got_baseline - baseline) <= 0.3 * case when baseline = 0 then 1.0::double else abs(baseline) end, false) as baseline_ok,
coalesce(sign(cohort - baseline) = sign(got_cohort - got_baseline) and sign(cohort - baseline) <> 0, false) as direction_ok from ex left join lg on lg.type = ex.type and lg.category = ex.category""")  # fmt: skip
add("band_l1", lambda s, d: _band_l1(s, d),
    f"""with {STATE}, {pyramid_sql('idle_days <= 365.25')}, x as (select scope_id, band, non_coding as n, moved + coding as c, snapshot from pyr),
j as (select coalesce(a.scope_id, b.scope_id) as scope_id, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) as ln, abs(coalesce(a.c, 0) - coalesce(b.c, 0)) as lc, coalesce(b.n, 0) + coalesce(b.c, 0) as p
 from (select * from x where snapshot = {LAST_SQL}) a full join (select * from x where snapshot = timestamp '{YEAR_AGO}') b on a.scope_id = b.scope_id and a.band = b.band)
select scope_id, cast(sum(ln) as bigint) as l1_non_coding, cast(sum(lc) as bigint) as l1_coding, cast(sum(p) as bigint) as people, cast(sum(ln + lc) as bigint) as l1, sum(ln + lc) / nullif(sum(p), 0) as l1_rel from j group by 1""")  # fmt: skip
add("session_spans", lambda s, d: session_spans(click_events(s.read.parquet(f"{d}/events.parquet"))),
    """with e as (select props->>'$.k' as scope, user_id as contributor_id, ts from events),
g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by scope, contributor_id order by ts)) > 21600000000 then 1 else 0 end as brk from e),
k as (select *, sum(brk) over (partition by scope, contributor_id order by ts rows unbounded preceding) as i from g)
select scope, contributor_id, min(ts) as span_start, max(ts) as span_end, count(*) as events from k group by scope, contributor_id, i""")  # fmt: skip


def _by_region(spark, d):
    src = _src(spark, d)
    ev = balance.by_attribute(src.events(), src.scopes())
    names = src.scopes().select(F.xxhash64("language").alias("scope_id"), F.col("language").alias("value")).distinct()
    m = balance.metrics(state.state_at(spans.activity_spans(ev.drop("value")), [LAST]))
    return m.join(names, "scope_id").select("value", "coding", "non_coding", "new", "experienced", "total", "ccr", "ncr", "type")


def _band_l1(spark, d):
    at = _state(spark, d, [YEAR_AGO, LAST])
    now, then = (balance.pyramid(at.filter(F.col("snapshot") == midnight(x))) for x in (LAST, YEAR_AGO))
    return sensitivity.band_l1(now, then)
