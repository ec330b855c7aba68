"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (2), bad (0) or abstains (1). The documents are counted by
vote pattern - at most 3^rules patterns, whatever the corpus' size - and
expectation-maximisation over these counts estimates how often each rule gives
each vote on good and on bad documents. A document is kept where its posterior
probability of being good is at least ``threshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanstat.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
#: Words in the window whose repetition counts.
WINDOW = 8
ROUNDS = 20

#: (rule, votes bad when, votes good when), over the features' columns. Ratios are
#: compared as products of integers, so every engine gives the same votes.
RULES = (
    ("symbols", "10 * n_symbols > word_chars", "100 * n_symbols <= word_chars"),
    ("symbol_words", "10 * n_symbol_words > 3 * n_words", "100 * n_symbol_words <= 5 * n_words"),
    ("letters", "100 * n_letters < 88 * word_chars", "100 * n_letters >= 92 * word_chars"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    ("capitals", "10 * n_capitals > 5 * word_chars", "10 * n_capitals <= 2 * word_chars"),
    ("word_length", "word_chars > 14 * n_words or 2 * word_chars < 5 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    ("exclaims", "10 * n_exclaims > 2 * n_words", "100 * n_exclaims <= 5 * n_words"),
    ("length", "n_words < 20", "n_words >= 50"),
    ("variety", "20 * n_distinct < n_words", "10 * n_distinct >= 3 * n_words or n_words >= 2000"),
)


def features(docs: DataFrame) -> DataFrame:
    """Counts over each whole text; a null text counts as empty."""
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.expr(rf"array_remove(split(t, r'{SPACE}'), '')").alias("w"), F.expr(r"filter(split(t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')").alias("l"))
    d = d.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.expr("length(regexp_replace(t, r'[^#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.expr("size(filter(w, x -> x rlike '[#*$%&|<>]'))").cast("long").alias("n_symbol_words"),
        F.expr(r"length(regexp_replace(t, r'[^\p{L}]+', ''))").cast("long").alias("n_letters"),
        F.expr(r"length(regexp_replace(t, r'[^\p{Lu}]+', ''))").cast("long").alias("n_capitals"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    ).drop("w")
    # Hashes of 2, 4 and 8 words, each from two of half the length.
    for k in (1, 2, 4):
        n = f"greatest(size(h) - {k}, 0)"
        d = d.withColumn("h", F.expr(f"zip_with(slice(h, 1, {n}), slice(h, {k + 1}, {n}), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("s", F.expr("case when size(array_distinct(h)) < size(h) then sort_array(transform(h, (x, i) -> struct(x as x, i as i))) end")).drop("h")
    d = d.withColumn("p", F.expr("sort_array(transform(filter(s, (a, k) -> a.x <=> get(s, k - 1).x or a.x <=> get(s, k + 1).x), a -> a.i))")).drop("s")
    covered = f"aggregate(p, struct(0L as n, 0 as e), (a, i) -> struct(a.n + i + {WINDOW} - greatest(i, a.e) as n, i + {WINDOW} as e), a -> a.n)"
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("p")


def pattern_sql() -> str:
    """A document's votes as one number, a digit of base 3 for each rule."""
    return " + ".join(f"{3**j} * (case when {bad} then 0 when {good} then 2 else 1 end)" for j, (_, bad, good) in enumerate(RULES))


def posteriors(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern and its posterior ``p_good``, from the counts (pattern, n).

    The start takes a pattern with b bad votes as good with probability
    1 / (1 + e^(3b - 3)). One row holds all patterns; a round is one E and one M
    step within an expression. Counts are smoothed by one.
    """
    m = len(RULES)
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("pattern").alias("c"), F.col("n").cast("double").alias("n")))).alias("raw"))
    one = one.select(F.expr(f"transform(raw, k -> struct(k.c as c, k.n as n, transform(sequence(0, {m - 1}), j -> cast(floor(k.c / pow(3, j)) as int) % 3) as v))").alias("k"))
    start = "transform(k, x -> 1D / (1D + exp(3D * size(filter(x.v, y -> y = 0)) - 3D)))"
    total = "aggregate(zip_with(k, post, (x, p) -> x.n * {p}), 0D, (a, y) -> a + y)"
    share = f"transform(sequence(0, {3 * m - 1}), t -> (aggregate(zip_with(k, post, (x, p) -> if(x.v[cast(t div 3 as int)] = t % 3, x.n * {{p}}, 0D)), 0D, (a, y) -> a + y) + 1D) / ({total} + 3D))"
    good, bad = share.format(p="p"), share.format(p="(1D - p)")
    g, b = total.format(p="p"), total.format(p="(1D - p)")
    logit = f"aggregate(sequence(0, {m - 1}), th.o, (a, j) -> a + ln(th.g[3 * j + x.v[j]]) - ln(th.b[3 * j + x.v[j]]))"
    step = f"transform(array(struct(ln({g} + 1D) - ln({b} + 1D) as o, {good} as g, {bad} as b)), th -> transform(k, x -> 1D / (1D + exp(-({logit})))))[0]"
    one = one.withColumn("post", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (post, r) -> {step})"))
    return one.select(F.explode(F.arrays_zip(F.col("k.c").alias("pattern"), F.col("post").alias("p_good"))).alias("z")).select("z.pattern", "z.p_good")


def judge(docs: DataFrame, threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """All features of each document, its posterior p_good, base_failed and kept.

    A null or empty text fails the base rule; repeated rows are judged once each
    and count as often in the estimate; other columns aren't read.
    """
    f = features(docs).withColumn("pattern", F.expr(f"cast({pattern_sql()} as int)"))
    f = f.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    f = stored(f, "quality-features")
    known = posteriors(f.groupBy("pattern").agg(F.count("*").alias("n")), rounds)
    # Bounded: at most 3^rules rows.
    out = f.join(F.broadcast(known), "pattern")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    return judge(docs, threshold).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    The row itself goes along through the features, so no text is shuffled; it is
    stored once with its pattern, so no feature is computed twice. Only the table of
    patterns, bounded by 3^rules rows, is broadcast. Null and empty texts go, an
    empty table stays empty, repeated rows are judged alike.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc_id"), "text")
    f = features(whole).withColumn("pattern", F.expr(f"coalesce(cast({pattern_sql()} as int), 0)"))
    f = stored(f.select("doc_id", "pattern", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed")), "quality-rows")
    known = posteriors(f.groupBy("pattern").agg(F.count("*").alias("n")))
    good = (~F.col("base_failed")) & (F.col("p_good") >= threshold)
    return f.join(F.broadcast(known), "pattern").where(good).select(*[F.col(f"doc_id.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def oracle(threshold: float = 0.5, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``quality`` over the view documents."""
    m = len(RULES)
    word = r"[^\x20\x09-\x0D]+"
    sql = rf"""
with base as materialized (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) as l from documents),
spots as (select r, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from base where len(w) > {WINDOW}),
wins as (select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from spots),
twice as (select r, i from (select r, i, count(*) over (partition by r, s) as c from wins) where c > 1),
rep as (select r, count(distinct j) as n from (select r, unnest(range(i, i + {WINDOW})) as j from twice) group by r),
feat as materialized (
  select base.r, doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) as bigint) as n_symbol_words,
    cast(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) as bigint) as n_letters,
    cast(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) as bigint) as n_capitals,
    cast(length(t) - length(replace(t, '!', '')) as bigint) as n_exclaims,
    cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    cast(len(list_distinct(w)) as bigint) as n_distinct, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from base left join rep on base.r = rep.r),
pat as materialized (select *, {pattern_sql()} as pattern, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from feat),
cnt as materialized (select pattern, cast(count(*) as double) as n from pat group by pattern),
votes as materialized (select pattern, j, cast(floor(pattern / pow(3, j)) as bigint) % 3 as v from cnt, (select unnest(range({m})) as j)),
em0 as materialized (select cnt.pattern, n, 1.0 / (1.0 + exp(3.0 * bad - 3.0)) as p from cnt join (select pattern, count(*) filter (v = 0) as bad from votes group by pattern) using (pattern)),"""
    for i in range(rounds):
        sql += f"""
tot{i} as materialized (select sum(n * p) as g, sum(n * (1 - p)) as b from em{i}),
th{i} as materialized (select j, v, (sum(n * p) + 1) / (any_value(g) + 3) as g, (sum(n * (1 - p)) + 1) / (any_value(b) + 3) as b from em{i} join votes using (pattern), tot{i} group by j, v),
em{i + 1} as materialized (select e.pattern, any_value(e.n) as n, 1.0 / (1.0 + exp(-(any_value(ln(t.g + 1) - ln(t.b + 1)) + sum(ln(h.g) - ln(h.b))))) as p
  from em{i} e join votes using (pattern) join th{i} h on h.j = votes.j and h.v = votes.v, tot{i} t group by e.pattern),"""
    return sql[:-1] + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and p >= {threshold} as kept
from pat join em{rounds} using (pattern)"""
