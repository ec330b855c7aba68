"""The queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanstat.functions import names, stats
from spanstat.operators import analytics, compare, embed, filters, moments, ontology, overlap, permute, regions, sorting
from spanstat.plans.tables import GENOME, ctes, load, view
from spanstat.schema import BIN, LayerConfig, bins_of
from spanstat.session import checkpointed
from spanstat.sources import bed, scores, split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

THETA = "q.chrom = d.chrom and d.start < q.stop and d.stop > q.start"
QD = ctes("fx_query", "fx_db")


def query(sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{QD} select q.sid as q_sid, d.sid as d_sid, count(*) as overlap_count, cast(sum(least(q.stop, d.stop) - greatest(q.start, d.start)) as bigint) as overlap_bp from fx_query q join fx_db d on {THETA} group by 1, 2")
def overlap_counts(spark, sf):
    return overlap.overlap_counts(view(spark, sf, "fx_query"), view(spark, sf, "fx_db"))


@query(f"{QD} select q.sid as q_sid, d.sid as d_sid, q.chrom, q.start as query_start, q.stop as query_end, d.start as db_start, d.stop as db_end, least(q.stop, d.stop) - greatest(q.start, d.start) as intersection_bp from fx_query q join fx_db d on {THETA}")
def overlap_pairs(spark, sf):
    j = overlap.overlap_join(view(spark, sf, "fx_query"), view(spark, sf, "fx_db"))
    return j.selectExpr("q_sid", "d_sid", "q_chrom as chrom", "q_start as query_start", "q_stop as query_end", "d_start as db_start", "d_stop as db_end", "bp as intersection_bp")


@query(f"{ctes('fx_snp', 'fx_db')} select q.sid as q_sid, d.sid as d_sid, count(*) as overlap_count, cast(sum(least(q.stop, d.stop) - greatest(q.start, d.start)) as bigint) as overlap_bp from fx_snp q join fx_db d on {THETA} group by 1, 2")
def overlap_counts_snp(spark, sf):
    return overlap.overlap_counts(view(spark, sf, "fx_snp"), view(spark, sf, "fx_db"))


@query(f"{QD} select concat('qry_', q.sid, '.bed') as query_name, concat('src_', d.sid, '.bed') as db_name, count(*) as overlap_count, row_number() over (order by count(*) desc, q.sid, d.sid) as place from fx_query q join fx_db d on {THETA} group by q.sid, d.sid")
def result_order(spark, sf):
    from pyspark.sql import Window

    c = overlap_counts(spark, sf)
    place = F.row_number().over(Window.orderBy(F.desc("overlap_count"), "q_sid", "d_sid"))
    return c.select(F.concat(F.lit("qry_"), "q_sid", F.lit(".bed")).alias("query_name"), F.concat(F.lit("src_"), "d_sid", F.lit(".bed")).alias("db_name"), "overlap_count", place.alias("place"))


@query(f"{ctes('fx_query', 'fx_mask')} select q.* from fx_query q where not exists (select 1 from fx_mask d where {THETA})")
def anti_overlap(spark, sf):
    return overlap.anti_overlap(view(spark, sf, "fx_query"), view(spark, sf, "fx_mask"))


@query(f"{ctes('fx_query', 'fx_mask')} select q.sid, q.chrom, greatest(q.start, d.start) as start, least(q.stop, d.stop) as stop from fx_query q join fx_mask d on {THETA}")
def clip_whitelist(spark, sf):
    return overlap.clip(view(spark, sf, "fx_query"), view(spark, sf, "fx_mask"))


ISLANDS = "select chrom, min(start) as start, max(stop) as stop from (select *, sum(n) over (partition by chrom order by start, stop rows unbounded preceding) as i from (select *, case when start <= max(stop) over (partition by chrom order by start, stop rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from {t})) group by chrom, i"


@query(f"{ctes('fx_db')} {ISLANDS.format(t='fx_db')}")
def region_merge(spark, sf):
    return regions.merge(view(spark, sf, "fx_db"))


SIZE = "case chrom when 'chr20' then 64444167 when 'chr21' then 46709983 else 50818468 end"


@query(f"{ctes('fx_mask')}, s as (select chrom, greatest(start - 10000, 0) as start, least(stop + 10000, {SIZE}) as stop from fx_mask) {ISLANDS.format(t='s')}")
def region_slop_union(spark, sf):
    return regions.merge(regions.slop(view(spark, sf, "fx_mask"), 10000, GENOME))


LAYER = "len(list_filter([128 * 4 ** k for k in range(13)], lambda t: t <= stop - start))"


@query(f"{ctes('fx_db')} select sid, chrom, start, stop, stop - start as size, cast({LAYER} as int) as layer from fx_db")
def layer_assign(spark, sf):
    d = view(spark, sf, "fx_db")
    size = F.col("stop") - F.col("start")
    return d.withColumn("size", size).withColumn("layer", LayerConfig().layer(size))


@query(f"{ctes('fx_query')}, g as (select sid, chrom, greatest(cast(ceil((stop - start) / 100.0) as bigint), 1) as l_int, (stop - start) / 100.0 as l from fx_query) select sid, chrom, l_int, round(sum(cast(l as double) / l_int), 6) as sum_scale, round(sum((cast(l as double) / l_int) * (cast(l as double) / l_int)), 6) as sum_scale2, count(*) as n from g group by 1, 2, 3")
def grouped_lengths(spark, sf):
    return rounded(moments.grouped_lengths(view(spark, sf, "fx_query"), GENOME))


@query(f"{ctes('fx_db')} select sid, cast(sum(stop - start) as bigint) as total_bp, 2 * count(*) as n_spikes from fx_db group by 1")
def total_coverage(spark, sf):
    return regions.total_coverage(view(spark, sf, "fx_db"), GENOME)


#: Running coverage per bin in hundredths, of the bins where it changes.
STEPS = "select sid, chrom, x // 100 as bin, s * (100 - x % 100) as d from {e} union all select sid, chrom, x // 100 + 1, s * (x % 100) from {e}"


def _runs(t: str) -> str:
    ends = f"(select sid, chrom, start as x, 1 as s from {t} union all select sid, chrom, stop, -1 from {t})"
    return f"select *, coalesce(lead(bin) over (partition by sid, chrom order by bin), ({SIZE} + 99) // 100) as until from (select sid, chrom, bin, sum(sum(d)) over (partition by sid, chrom order by bin) as cover from ({STEPS.format(e=ends)}) group by sid, chrom, bin having sum(d) <> 0)"


@query(f"{ctes('fx_mask')} select sid, chrom, bin, until, cast(cover as bigint) as cover from ({_runs('fx_mask')}) where cover <> 0")
def coverage_signal(spark, sf):
    return regions.coverage(view(spark, sf, "fx_mask"), GENOME)


def _cells(t: str) -> str:
    return f"select sid, chrom, unnest(range(bin, until)) as b, cover from ({_runs(t)}) where cover <> 0"


@query(f"{QD}, a as ({_cells('fx_query')}), b as ({_cells('fx_db')}) select a.sid as q_sid, b.sid as d_sid, round(cast(sum(a.cover * b.cover) as double) / 10000, 4) as dot from a join b using (chrom, b) group by 1, 2")
def coverage_dot(spark, sf):
    return rounded(regions.coverage_dot(view(spark, sf, "fx_query"), view(spark, sf, "fx_db"), GENOME), 4)


SHORT = (1, 10, 60)
N_BINS = " ".join(f"when '{k}' then {bins_of(v)}" for k, v in GENOME.items())
PREFIX = f"cells as ({_cells('fx_mask')}), grid as (select c as chrom, unnest(range(0, n + 1)) as j, n from (values {', '.join(f'({k!r}, {bins_of(v)})' for k, v in GENOME.items())}) t(c, n)), pre as (select chrom, j, n, sum(coalesce(cover, 0)) over (partition by grid.chrom order by j) / 100.0 as p from grid left join (select chrom, b + 1 as j, cover from cells) using (chrom, j))"


@query(f"{ctes('fx_mask')}, {PREFIX}, w as (select chrom, n, l, cast(p - case l when 1 then lag(p, 1) over v when 10 then lag(p, 10) over v else lag(p, 60) over v end as double) as x from (values (1), (10), (60)) t(l), pre window v as (partition by chrom, l order by j)) select 0 as sid, chrom, cast(any_value(n) as bigint) as n_bins, cast(l as bigint) as l, round(avg(x), 5) as mean, round(var_pop(x), 4) as var from w where x is not null group by chrom, l")
def moments_small_l(spark, sf):
    m = moments.moments(view(spark, sf, "fx_mask"), GENOME, SHORT)
    return m.select("sid", "chrom", "n_bins", "l", F.round("mean", 5).alias("mean"), F.round("var", 4).alias("var"))


SNP_O = f"o as (select q.sid as q_sid, count(*) as overlap_count, sum(least(q.stop, d.stop) - greatest(q.start, d.start)) / 100.0 as o from fx_snp q join fx_mask d on {THETA} group by 1)"
ERFC = "(with_t.t * (0.254829592 + with_t.t * (-0.284496736 + with_t.t * (1.421413741 + with_t.t * (-1.453152027 + with_t.t * 1.061405429)))) * exp(-llr))"


@query(
    f"{ctes('fx_snp', 'fx_mask')}, {SNP_O}, {PREFIX}, m as (select chrom, avg(x) as mean, var_pop(x) as var from (select chrom, cast(p - lag(p, 1) over (partition by chrom order by j) as double) as x from pre) group by 1),"
    " g as (select sid as q_sid, sum(mean * 0.01) as mu, sum(var * 0.0001) as var, sum(mean) as mu_raw from fx_snp join m using (chrom) group by 1),"
    " x as (select q_sid, overlap_count, cast(o as double) as o, mu, var, mu_raw, mu * mu / (var - mu) as r, mu / var as p from o join g using (q_sid)),"
    " y as (select *, case when var > mu then o * ln((1 - r / (r + o)) / (1 - p)) + r * ln(r / (r + o) / p) else o * mu_raw / mu * ln(o * mu_raw / mu / mu_raw) - (o * mu_raw / mu - mu_raw) end as llr from x),"
    f" with_t as (select *, 1 / (1 + 0.3275911 * sqrt(greatest(llr, 0))) as t from y)"
    f" select q_sid, 0 as d_sid, overlap_count, round(o, 6) as observed_bins, round(mu, 5) as mu, round(var, 4) as var, round(llr, 4) as llr, round(case when llr > 0 then case when o >= mu then {ERFC} / 2 else 1 - {ERFC} / 2 end else 1.0 end, 6) as p_value from with_t"
)
def stats_poisson_snp(spark, sf):
    d = view(spark, sf, "fx_mask")
    s = moments.score(view(spark, sf, "fx_snp"), d, moments.moments(d, GENOME, (1,)), GENOME)
    r = lambda c, k: F.round(c, k).alias(c)
    return s.select("q_sid", "d_sid", "overlap_count", r("observed_bins", 6), r("mu", 5), r("var", 4), r("llr", 4), r("p_value", 6))


@query()
def stats_nb(spark, sf):
    d = view(spark, sf, "fx_db")
    return moments.score(view(spark, sf, "fx_query"), d, moments.moments(d, GENOME), GENOME)


@query()
def pairwise_pval(spark, sf):
    return moments.pairwise(view(spark, sf, "fx_query"), view(spark, sf, "fx_db"), GENOME)


@query(f"{ctes('fx_db')} select sid, count(*) as n, cast(sum(stop - start) as bigint) as total, round(avg(stop - start), 6) as mean, round(stddev_pop(stop - start), 6) as std, min(stop - start) as least, max(stop - start) as largest, " + ", ".join(f"round(quantile_cont(stop - start, {p / 100}), 6) as p{p}" for p in analytics.PERCENTILES) + " from fx_db group by 1")
def corpus_stats(spark, sf):
    d = view(spark, sf, "fx_db").withColumn("size", F.col("stop") - F.col("start"))
    return rounded(analytics.corpus_stats(d, "size", ["sid"]))


@query(f"{ctes('fx_db')} select chrom, count(*) as n from fx_db group by 1 order by 2 desc, 1 limit 10")
def chrom_top10(spark, sf):
    return analytics.top(view(spark, sf, "fx_db"), "chrom")


@query(f"{ctes('fx_db')}, e as (select cast(min(stop - start) as double) as lo, cast(max(stop - start) as double) as hi from fx_db) select cast(least(floor((stop - start - lo) / (hi - lo) * 50), 49) as bigint) as bucket, count(*) as n from fx_db, e group by 1")
def size_histogram(spark, sf):
    return analytics.histogram(view(spark, sf, "fx_db"), F.col("stop") - F.col("start"))


CELLS = "c as (select l_suppkey as cell, concat(l_returnflag, l_linestatus) as state, avg(l_extendedprice) as score from lineitem group by 1, 2)"


def _cell_scores(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.concat("l_returnflag", "l_linestatus").alias("state")).agg(F.avg("l_extendedprice").alias("score"))


@query(f"with {CELLS}, z as (select cell, (score - avg(score) over w) / case when stddev_pop(score) over w = 0 then 1 else stddev_pop(score) over w end as z from c window w as (partition by state)) select cell, round(sum(z) / (select count(distinct state) from c), 6) as z from z group by cell")
def zscore_state(spark, sf):
    return rounded(analytics.zscores(_cell_scores(spark, sf), "cell", "state", "score"))


STATES = ("AF", "AO", "NF", "NO", "RF", "RO")


@query(f"with {CELLS} select cell, " + ", ".join(f"round(coalesce(max(score) filter (state = '{s}'), 0), 4) as {s}" for s in STATES) + " from c group by cell")
def pivot_matrix(spark, sf):
    return rounded(analytics.pivot(_cell_scores(spark, sf), "cell", "state", "score", STATES), 4)


PARTS = "p as (select l_partkey, cast(sum(l_quantity) as double) as x, cast(sum(l_extendedprice) as double) as y from lineitem group by 1)"


def _parts(spark, sf):
    d = load(spark, sf, "lineitem").groupBy("l_partkey")
    return d.agg(F.sum("l_quantity").cast("double").alias("x"), F.sum("l_extendedprice").cast("double").alias("y"))


@query(f"with {PARTS} select round(corr(x, y), 6) as r from p")
def pearson(spark, sf):
    return rounded(analytics.pearson(_parts(spark, sf), "x", "y"))


AVG_RANK = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"


@query(f"with {PARTS} select round(corr(rx, ry), 6) as r from (select {AVG_RANK.format(c='x')} as rx, {AVG_RANK.format(c='round(y, 2)')} as ry from p)")
def spearman(spark, sf):
    return rounded(analytics.spearman(_parts(spark, sf).withColumn("y", F.round("y", 2)), "x", "y"))


@query(f"with {PARTS} select l_partkey, cast({AVG_RANK.format(c='x')} as double) as rank from p")
def avg_rank(spark, sf):
    return analytics.average_rank(_parts(spark, sf), "x", "rank").select("l_partkey", "rank")


@query(f"with {PARTS} select round(sum(x * y) / sum(x * x), 6) as slope from p")
def least_squares(spark, sf):
    return rounded(analytics.least_squares(_parts(spark, sf), F.col("x"), F.col("y")))


@query(f"with {CELLS}, d as (select *, cast(cell % 4 = 0 as int) as y from c), r as (select *, sum(y) over w * 1.0 / sum(y) over (partition by state) as tpr, sum(1 - y) over w * 1.0 / sum(1 - y) over (partition by state) as fpr from d window w as (partition by state order by round(score, 6) desc, cell rows unbounded preceding)) select state, round(sum((fpr - f0) * (tpr + t0) / 2), 6) as auc from (select *, coalesce(lag(fpr) over v, 0) as f0, coalesce(lag(tpr) over v, 0) as t0 from r window v as (partition by state order by round(score, 6) desc, cell)) group by state")
def roc_auc(spark, sf):
    d = _cell_scores(spark, sf).withColumn("score", F.round("score", 6)).withColumn("y", (F.col("cell") % 4 == 0).cast("int"))
    return rounded(analytics.auc(d, "state", "score", "y", "cell"))


@query(f"with {CELLS} select cell, state, round(1 - (row_number() over (partition by state order by round(score, 6) desc, cell) - 1) * 1.0 / count(*) over (partition by state), 6) as share from c")
def rank_pool(spark, sf):
    d = _cell_scores(spark, sf).withColumn("score", F.round("score", 6))
    return rounded(analytics.rank_share(d, "state", "score", "cell").select("cell", "state", "share"))


WORDS = {"brass": "metal", "steel": "metal", "tin": "soft", "copper": "soft", "nickel": "metal"}
FIRST = "case " + " ".join(f"when contains(upper(p_type), '{k.upper()}') then '{v}'" for k, v in WORDS.items()) + " end"


@query(f"select p_partkey, {FIRST} as category, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"case when contains(upper(p_type), '{k.upper()}') then '{v}' end" for k, v in WORDS.items()) + "], lambda x: x is not null))), ',') as labels from part")
def keyword_labels(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", analytics.first_category(F.col("p_type"), WORDS).alias("category"), F.array_join(analytics.all_categories(F.col("p_type"), WORDS), ",").alias("labels"))


@query(f"{ctes('fx_db')} select sid, chrom, start, stop from fx_db")
def parse_bed_lines(spark, sf):
    d = view(spark, sf, "fx_db").select("sid", F.concat_ws("\t", "chrom", "start", "stop").alias("value"))
    return bed.intervals(d)


@query("select s_suppkey, row_number() over (order by cast(regexp_extract(s_name, '(\\d+)$', 1) as bigint), s_name) as place from supplier")
def natural_sort(spark, sf):
    from pyspark.sql import Window

    return load(spark, sf, "supplier").select("s_suppkey", F.row_number().over(Window.orderBy(sorting.natural_key(F.col("s_name")))).alias("place"))


@query("select p_partkey, regexp_replace(concat(p_name, '.clean.bed.gz'), '(\\.clean)?\\.bed(\\.gz)?$', '') as name from part")
def name_parse(spark, sf):
    return load(spark, sf, "part").select("p_partkey", names.strip_bed(F.concat("p_name", F.lit(".clean.bed.gz"))).alias("name"))


@query(f"{ctes('fx_query')}, l as (select distinct greatest(cast(ceil((stop - start) / 100.0) as bigint), 1) * 7 as l from fx_query) select l, cast(case when l <= 100 then l - 1 else 100 + floor(ln(l / 100.0) / ln(1.01)) - 1 end as int) as slot from l")
def compact_index(spark, sf):
    l = (F.greatest(F.ceil((F.col("stop") - F.col("start")) / F.lit(100.0)), F.lit(1)) * 7).cast("long")
    return view(spark, sf, "fx_query").select(l.alias("l")).distinct().withColumn("slot", stats.compact_index(F.col("l")))


TRIALS, MARKS = 20, (5, 20)
#: The milestones of the reference's workflow.
ALL_TRIALS, ALL_MARKS = 10000, (100, 500, 1000, 5000, 10000)
MC = "select q_sid, d_sid, m as milestone, any_value(observed) as observed, count(*) filter (trial < m and n >= observed) as exceed, round(count(*) filter (trial < m and n >= observed) * 1.0 / m, 6) as p_value from (select o.*, c.trial, c.n from o left join c using (q_sid, d_sid)), (values {marks}) t(m) group by 1, 2, 3"


def _mc_sql(move: str, marks: tuple[int, ...] = MARKS) -> str:
    obs = f"o as (select q.sid as q_sid, d.sid as d_sid, count(*) as observed from fx_snp q join fx_mask d on {THETA} group by 1, 2)"
    return f"{ctes('fx_snp', 'fx_mask')}, {obs}, mv as ({move}), c as (select q.sid as q_sid, d.sid as d_sid, trial, count(*) as n from mv q join fx_mask d on {THETA} where q.start < q.stop group by 1, 2, 3) {MC.format(marks=', '.join(f'({m})' for m in marks))}"


@query(_mc_sql(f"select sid, trial, chrom, greatest(start + ((trial * 7919 + 104729) * 6101) % 400001 - 200000, 0) as start, least(stop + ((trial * 7919 + 104729) * 6101) % 400001 - 200000, {SIZE}) as stop from fx_snp, (select unnest(range({TRIALS})) as trial)"))
def mc_circular(spark, sf):
    by = lambda r: ((r.trial * 7919 + 104729) * 6101) % 400001 - 200000
    return rounded(permute.montecarlo(view(spark, sf, "fx_snp"), view(spark, sf, "fx_mask"), MARKS, "circular", genome=GENOME, offset=by))


@query(_mc_sql(f"select sid, trial, chrom, (start * 31 + trial * 7919 * 6101) % ({SIZE} - 1) as start, (start * 31 + trial * 7919 * 6101) % ({SIZE} - 1) + 1 as stop from fx_snp, (select unnest(range({ALL_TRIALS})) as trial)", ALL_MARKS))
def mc_shuffle(spark, sf):
    at = lambda r: (r.start * 31 + r.trial * 7919 * 6101) % (r.size - 1)
    return rounded(permute.montecarlo(view(spark, sf, "fx_snp"), view(spark, sf, "fx_mask"), ALL_MARKS, "shuffle", genome=GENOME, offset=at))


TILES = "tiles as (select distinct sid, chrom, unnest(range(start // 100, (stop - 1) // 100 + 1)) as tile from {t})"
GRAM = f"n as (select sid, count(*) as n from tiles group by 1), g as (select a.sid as a_sid, b.sid as b_sid, count(*) as c from tiles a join tiles b on a.chrom = b.chrom and a.tile = b.tile and a.sid <= b.sid group by 1, 2)"


@query(f"{ctes('fx_db')}, {TILES.format(t='fx_db')}, {GRAM} select a_sid, b_sid, round(c / sqrt(cast(x.n as double) * y.n), 6) as cosine from g join n x on x.sid = a_sid join n y on y.sid = b_sid")
def tile_cosine_gram(spark, sf):
    return rounded(embed.cosine_gram(embed.tiles(view(spark, sf, "fx_db"))))


@query(f"{ctes('fx_db')}, {TILES.format(t='fx_db')}, {GRAM}, s as (select a_sid, b_sid, round(c / sqrt(cast(x.n as double) * y.n), 6) as cosine from g join n x on x.sid = a_sid join n y on y.sid = b_sid where a_sid <> b_sid), pairs as (select a_sid as q_sid, b_sid as d_sid, cosine from s union all select b_sid, a_sid, cosine from s) select * from (select *, row_number() over (partition by q_sid order by cosine desc, d_sid) as place from pairs) where place <= 3")
def tile_topn(spark, sf):
    g = tile_cosine_gram(spark, sf).where("a_sid <> b_sid")
    both = g.selectExpr("a_sid as q_sid", "b_sid as d_sid", "cosine").unionByName(g.selectExpr("b_sid as q_sid", "a_sid as d_sid", "cosine"))
    return embed.top_similar(both, 3)


@query()
def svd_embed(spark, sf):
    # Read four times; its rows are bounded by sources and tiles.
    t = checkpointed(embed.tiles(view(spark, sf, "fx_db")))
    return embed.svd_project(t, embed.svd_index(t), checkpointed(embed.tiles(view(spark, sf, "fx_query"))))


@query(f"{ctes('fx_db')}, t as (select distinct chrom, stop // 1000000 as tile from fx_db) select t.chrom, t.tile, count(d.start) as n_before from t join fx_db d on d.chrom = t.chrom and d.start < t.tile * 1000000 group by 1, 2")
def jump_table_counts(spark, sf):
    from pyspark.sql import Window

    d = view(spark, sf, "fx_db")
    # Rows per tile first, so the ordered window holds tiles, not rows.
    per = d.groupBy("chrom", F.expr("start div 1000000").alias("tile")).agg(F.count("*").alias("n"))
    asked = d.select("chrom", F.expr("stop div 1000000").alias("tile")).distinct().withColumn("n", F.lit(0).cast("long"))
    both = per.withColumn("asked", F.lit(0)).unionByName(asked.withColumn("asked", F.lit(1)))
    both = both.groupBy("chrom", "tile").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    w = Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("n_before", F.sum("n").over(w)).where("asked = 1 and n_before > 0").select("chrom", "tile", "n_before")


@query(f"{ctes('fx_query')} select sid, count(*) as n from fx_query group by 1")
def source_counts(spark, sf):
    return view(spark, sf, "fx_query").groupBy("sid").agg(F.count("*").alias("n"))


@query(f"{QD}, o as (select sid, count(*) as n, round(avg((stop - start) / 100.0), 6) as mean_bins from fx_query group by 1) select * from o")
def mean_interval_bins(spark, sf):
    return rounded(view(spark, sf, "fx_query").groupBy("sid").agg(F.count("*").alias("n"), F.avg((F.col("stop") - F.col("start")) / F.lit(float(BIN))).alias("mean_bins")))


@query(f"{ctes('fx_db')} select sid, chrom, start, stop, stop - start as size from fx_db where stop - start >= 190")
def min_size_filter(spark, sf):
    return filters.min_size(view(spark, sf, "fx_db")).withColumn("size", F.col("stop") - F.col("start"))


ODD_CHROM = "case when o_orderkey % 3 = 0 then concat('chr', cast(o_orderkey % 25 as varchar(9))) when o_orderkey % 3 = 1 then 'chrX' when o_orderkey % 5 = 0 then 'chrUn_1' else 'scaffold1' end"


@query(f"select * from (select o_orderkey, {ODD_CHROM} as chrom from orders) where regexp_matches(chrom, '^chr[0-9XY]+')")
def normal_chromosome_filter(spark, sf):
    return filters.normal_chromosomes(load(spark, sf, "orders").select("o_orderkey", F.expr(ODD_CHROM.replace("varchar(9)", "string")).alias("chrom")))


@query("select l_orderkey, l_linenumber, l_discount as p from lineitem where l_discount <= 0.05")
def p_threshold(spark, sf):
    d = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("p"))
    return filters.significant(d, "p", 0.05)


@query("select l_orderkey, l_linenumber, round(greatest(case when l_returnflag = 'R' then 1 - l_tax else l_tax end, 2.2250738585072014e-308), 9) as p from lineitem")
def direction_fix(spark, sf):
    alt = F.when(F.col("l_returnflag") == "R", "l").when(F.col("l_returnflag") == "A", "g")
    p = filters.directed(F.col("l_tax"), F.coalesce(alt, F.lit("two.sided")))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 9).alias("p"))


TOOLS = "a as (select l_suppkey as name, round(avg(l_discount), 9) as score from lineitem where l_suppkey % 3 <> 0 group by 1), b as (select l_suppkey as name, round(avg(l_tax), 9) as score from lineitem where l_suppkey % 2 = 0 group by 1)"


@query(f"with {TOOLS} select name, a.score as x, b.score as y from a join b using (name)")
def tool_alignment(spark, sf):
    d = load(spark, sf, "lineitem")
    a, b = (d.where(w).groupBy(F.col("l_suppkey").alias("name")).agg(F.round(F.avg(c), 9).alias("score")) for w, c in (("l_suppkey % 3 <> 0", "l_discount"), ("l_suppkey % 2 = 0", "l_tax")))
    return compare.aligned(a, b, "name", "score")


@query(f"{QD}, c as (select q.sid as q_sid, d.sid as d_sid, count(*) as n from fx_query q join fx_db d on {THETA} group by 1, 2), s as (select q.sid as q_sid, d.sid as d_sid, round((q.sid + 1) * 0.1 + d.sid, 6) as p_value from (select distinct sid from fx_query) q, (select unnest(range(0, 15)) as sid) d) select s.q_sid, cast(s.d_sid as int) as d_sid, cast(s.p_value as double) as p_value, coalesce(n, 0) as overlap_count from s left join c using (q_sid, d_sid)")
def counts_with_scores(spark, sf):
    q, d = view(spark, sf, "fx_query"), view(spark, sf, "fx_db")
    s = q.select(F.col("sid").alias("q_sid")).distinct().withColumn("d_sid", F.explode(F.sequence(F.lit(0), F.lit(14))))
    s = s.withColumn("p_value", F.round((F.col("q_sid") + 1) * 0.1 + F.col("d_sid"), 6))
    return compare.with_counts(s, overlap.overlap_counts(q, d))


ORDER = ("soft", "metal")


@query(f"select p_partkey, category, cast(case category when 'soft' then 1 when 'metal' then 2 else 3 end as int) as place from (select p_partkey, {FIRST} as category from part)")
def category_order(spark, sf):
    d = load(spark, sf, "part").select("p_partkey", analytics.first_category(F.col("p_type"), WORDS).alias("category"))
    return d.withColumn("place", compare.category_place(F.coalesce("category", F.lit("")), ORDER))


@query("select concat('cell', l_suppkey % 7, '_', case l_returnflag when 'A' then 'TssA' when 'N' then 'Quies' else 'Enh' end) as name, concat('chr', l_linenumber) as chrom, l_orderkey * 10 as start, l_orderkey * 10 + 5 as stop from lineitem")
def state_split(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.concat(F.lit("E"), F.col("l_suppkey") % 7).alias("sample"), F.concat(F.lit("chr"), "l_linenumber").alias("chrom"), (F.col("l_orderkey") * 10).alias("start"), (F.col("l_orderkey") * 10 + 5).alias("stop"), F.col("l_returnflag").alias("state"))
    cells = spark.createDataFrame([(f"E{i}", f"cell{i}") for i in range(7)], "sample string, cell string")
    return split.by_state(rows, cells, spark.createDataFrame([("A", "TssA"), ("N", "Quies"), ("R", "Enh")], "state string, label string"))


@query("select regexp_replace(replace(replace(replace(trim(p_name), '''', ''), '/', '_'), ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') as trait, concat('chr', p_size) as chrom, p_partkey * 100 as start, p_partkey * 100 + 1 as stop from part")
def trait_split(spark, sf):
    d = load(spark, sf, "part").select("p_name", F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("c"), F.concat((F.col("p_partkey") * 100).cast("string"), F.lit(".0")).alias("pos"))
    return split.by_trait(d, "p_name", "c", "pos")


@query("select p_partkey, trim(regexp_replace(lower(replace(p_type, '_', ' ')), '\\s+', ' ', 'g')) as form from part")
def trait_forms(spark, sf):
    d = load(spark, sf, "part").select("p_partkey", F.concat("p_type", F.lit("  Levels")).alias("t"))
    return d.select("p_partkey", F.get(names.candidates(F.col("t")), F.lit(1)).alias("form"))


TREE = "e as (select c_custkey as child, c_custkey // 3 as parent from customer where c_custkey > 0)"


@query(f"with recursive {TREE}, a(node, ancestor) as (select n, n from (select child as n from e union select parent from e) union select a.node, e.parent from a join e on e.child = a.ancestor) select node, ancestor from a")
def ontology_ancestors(spark, sf):
    e = load(spark, sf, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 3").alias("parent"))
    return ontology.ancestors(e)


@query("select l_orderkey, l_linenumber, round(-log10(greatest(l_discount, 1e-300)), 6) as score from lineitem")
def minus_log10(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(stats.minus_log10(F.col("l_discount")), 6).alias("score"))


@query(f"{ctes('fx_db')} select value, row_number() over (order by cast(substr(chrom, 4) as int), start, stop, value) as place from (select *, concat_ws(chr(9), chrom, start, stop) as value from fx_db where sid = 3)")
def bed_sort(spark, sf):
    from pyspark.sql import Window

    lines = view(spark, sf, "fx_db").where("sid = 3").select(F.concat_ws("\t", "chrom", "start", "stop").alias("value"))
    # Sorted over all partitions; a row's place is counted from its partition's first.
    d = sorting.sort_bed(lines, natural=True).select("value", F.monotonically_increasing_id().alias("id")).withColumn("part", F.shiftright("id", 33))
    first = d.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(F.broadcast(first), "part").select("value", (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


@query(f"{ctes('fx_db')} select sid, count(*) as n, cast(sum(stop - start) as bigint) as total_bp, row_number() over (order by count(*) desc, sid) as place from fx_db group by 1")
def per_file_stats(spark, sf):
    from pyspark.sql import Window

    # One row per source: the ordered window is small.
    d = view(spark, sf, "fx_db").groupBy("sid").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("total_bp"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "sid")))


@query(f"{ctes('fx_db')}, v as (select log10(stop - start + 1) as x from fx_db), e as (select min(x) as lo, max(x) as hi from v) select cast(least(floor((x - lo) / (hi - lo) * 50), 49) as bigint) as bucket, count(*) as n from v, e group by 1")
def log_size_histogram(spark, sf):
    return analytics.histogram(view(spark, sf, "fx_db"), F.log10(F.col("stop") - F.col("start") + 1))


@query(f"{ctes('fx_mask')}, {PREFIX}, m as (select chrom, l, avg(x) as mean, var_pop(x) as var from (select chrom, l, cast(p - case l when 1 then lag(p, 1) over v when 10 then lag(p, 10) over v else lag(p, 60) over v end as double) as x from (values (1), (10), (60)) t(l), pre window v as (partition by chrom, l order by j)) where x is not null group by chrom, l), r as (select l, var / mean as r, row_number() over (partition by l order by var / mean) - 1 as k, count(*) over (partition by l) as n from m where mean > 1e-10) select cast(l as bigint) as l, round(max(r) filter (k = n // 2), 4) as median_ratio, avg(case when r > 1 then 1.0 else 0.0 end) as overdispersed from r group by l")
def moment_diagnostics(spark, sf):
    d = moments.diagnostics(moments.moments(view(spark, sf, "fx_mask"), GENOME, SHORT))
    return d.select("l", F.round("median_ratio", 4).alias("median_ratio"), "overdispersed")


@query("select concat('s', s_suppkey % 10) as name, cast(m as int) as milestone, round(s_suppkey / (m * 10.0), 9) as p from supplier, (values (100), (500)) t(m) where s_suppkey < 50")
def milestone_report(spark, sf):
    d = load(spark, sf, "supplier").where("s_suppkey < 50").select("s_suppkey")
    row = lambda m: F.concat(F.lit("x/s"), F.col("s_suppkey") % 10, F.lit(".clean.bed.gz\t3\t"), F.round(F.col("s_suppkey") / F.lit(m * 10.0), 9))
    parts = [d.select(F.lit(3 * i + 2).alias("line"), row(m).alias("value")) for i, m in enumerate((100, 500))]
    marks = spark.createDataFrame([(0, "# milestone=100 trials=100"), (1, "db_name\tobserved\tp_value"), (3, "# milestone=500 trials=500"), (4, "s9.bed\t1\t-")], "line int, value string")
    out = scores.milestones(marks.unionByName(parts[0]).unionByName(parts[1]), "line")
    return out.select("name", "milestone", F.round("p", 9).alias("p"))


@query("select cast(l_suppkey as int) as d_sid, round(least(greatest(avg(l_discount) * 30, -1.0), 1.0), 6) as cosine from lineitem where l_partkey % 5 = 0 group by 1 order by 2 desc, 1 limit 10")
def reference_scores(spark, sf):
    d = load(spark, sf, "lineitem").where("l_partkey % 5 = 0").groupBy(F.col("l_suppkey").cast("int").alias("d_sid")).agg((F.avg("l_discount") * 30).alias("cosine"))
    return rounded(compare.best_similar(d, 10))


NEEDED = "with_t.t * (0.254829592 + with_t.t * (-0.284496736 + with_t.t * (1.421413741 + with_t.t * (-1.453152027 + with_t.t * 1.061405429)))) * exp(-llr)"
LENGTHS = (1, 5, 20, 45)
#: Query sets of four fixed lengths, whose window moments SQL can still express.
FIXED = "fl as (select sid, chrom, start, start + case when sid = 0 then 100 when sid = 1 then 480 when sid = 2 then 1950 else 4500 end as stop from fx_query)"
LAGS = " ".join(f"when {l} then lag(p, {l}) over v" for l in LENGTHS)
FIXED_M = f"m as (select chrom, l, avg(x) as mean, var_pop(x) as var from (select chrom, l, cast(p - case l {LAGS} end as double) as x from (values {', '.join(f'({l})' for l in LENGTHS)}) t(l), pre window v as (partition by chrom, l order by j)) where x is not null group by chrom, l)"
FIXED_N = "g as (select sid as q_sid, chrom, cast(ceil((stop - start) / 100.0) as bigint) as l, (stop - start) / 100.0 as b from fl), n as (select q_sid, sum(mean * cast(b as double) / g.l) as mu, sum(var * power(cast(b as double) / g.l, 2)) as var, sum(mean / g.l) as mu_raw from g join m on m.chrom = g.chrom and m.l = g.l group by 1)"


def _fixed(spark, sf):
    size = F.when(F.col("sid") == 0, 100).when(F.col("sid") == 1, 480).when(F.col("sid") == 2, 1950).otherwise(4500)
    return view(spark, sf, "fx_query").withColumn("stop", F.col("start") + size)


@query(f"{ctes('fx_query', 'fx_mask')}, {FIXED}, {PREFIX}, {FIXED_M}, {FIXED_N} select q_sid, 0 as d_sid, round(mu, 5) as mu, round(var, 3) as var, round(mu_raw, 5) as mu_raw from n")
def null_moments(spark, sf):
    store = moments.moments(view(spark, sf, "fx_mask"), GENOME, LENGTHS)
    n = moments.null_moments(_fixed(spark, sf), store, GENOME)
    return n.select("q_sid", "d_sid", F.round("mu", 5).alias("mu"), F.round("var", 3).alias("var"), F.round("mu_raw", 5).alias("mu_raw"))


SCORED = "x as (select q_sid, n_o, o, mu, var, mu_raw, mu * mu / (var - mu) as r, mu / var as p from o join n using (q_sid)), y as (select *, case when var > mu then o * ln((1 - r / (r + o)) / (1 - p)) + r * ln(r / (r + o) / p) else o * mu_raw / mu * ln(o / mu) - (o * mu_raw / mu - mu_raw) end as llr from x), with_t as (select *, 1 / (1 + 0.3275911 * sqrt(greatest(llr, 0))) as t from y)"
P_SQL = f"round(case when llr > 0 then case when o >= mu then {NEEDED} / 2 else 1 - {NEEDED} / 2 end else 1.0 end, 6) as p_value"


@query(f"{ctes('fx_query', 'fx_mask')}, {FIXED}, {PREFIX}, {FIXED_M}, {FIXED_N}, o as (select q.sid as q_sid, count(*) as n_o, cast(sum(least(q.stop, d.stop) - greatest(q.start, d.start)) / 100.0 as double) as o from fl q join fx_mask d on {THETA} group by 1), {SCORED} select q_sid, 0 as d_sid, n_o as overlap_count, round(o, 4) as observed_bins, round(llr, 3) as llr, {P_SQL} from with_t")
def stats_nb_fixed(spark, sf):
    d = view(spark, sf, "fx_mask")
    s = moments.score(_fixed(spark, sf), d, moments.moments(d, GENOME, LENGTHS), GENOME)
    return s.select("q_sid", "d_sid", "overlap_count", F.round("observed_bins", 4).alias("observed_bins"), F.round("llr", 3).alias("llr"), F.round("p_value", 6).alias("p_value"))


@query(f"{ctes('fx_query', 'fx_mask')}, {FIXED}, {PREFIX}, {FIXED_M}, {FIXED_N}, a as ({_cells('fl')}), o as (select a.sid as q_sid, 0 as n_o, cast(sum(a.cover * b.cover) as double) / 10000 as o from a join cells b using (chrom, b) group by 1), {SCORED} select q_sid, 0 as d_sid, round(o, 4) as observed_bins, round(llr, 3) as llr, {P_SQL} from with_t")
def pairwise_fixed(spark, sf):
    p = moments.pairwise(_fixed(spark, sf), view(spark, sf, "fx_mask"), GENOME, LENGTHS)
    return p.select("q_sid", "d_sid", F.round("observed_bins", 4).alias("observed_bins"), F.round("llr", 3).alias("llr"), F.round("p_value", 6).alias("p_value"))
