"""Sequence analytics: presence, runs, gaps, indices, transitions, Markov chains, breaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import breaks, cluster
from strandline.operators import sequence as seq
from strandline.plans import bindings as b
from strandline.plans.registry import query


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# Q1, X12
@query("presence_long", f"WITH {b.SQL_PRESENCE} SELECT place_id, phase_order, phase_code, presence FROM presence")
def presence_long(spark, d):
    return seq.long(b.place_states(spark, d))


@query(
    "sequence_string",
    f"""WITH {b.SQL_PRESENCE} SELECT place_id, string_agg(presence::VARCHAR, '' ORDER BY phase_order) AS sequence,
    'seq_' || string_agg(presence::VARCHAR, '' ORDER BY phase_order) AS sequence_display,
    coalesce(string_agg(phase_code, '-' ORDER BY phase_order) FILTER (presence = 1), 'none') AS phase_list FROM presence GROUP BY place_id""",
)
def sequence_string(spark, d):
    s = seq.sequence_string(F.col("states"))
    return b.place_states(spark, d).select("place_id", s.alias("sequence"), F.concat(F.lit("seq_"), s).alias("sequence_display"), seq.phase_list(F.col("states")).alias("phase_list"))


# Q2
@query(
    "run_events",
    f"""{b.SQL_SEQ} SELECT place_id, place_id || '_R' || run_number AS run_id, run_number, run_start AS run_start_order, run_end AS run_end_order,
    s.phase_code AS run_start_phase, e.phase_code AS run_end_phase, run_length FROM runs JOIN phase s ON s.phase_order = run_start JOIN phase e ON e.phase_order = run_end""",
)
def run_events(spark, d):
    return seq.run_events(b.place_states(spark, d), "place_id")


# Q3, J19
@query(
    "gap_events",
    f"""{b.SQL_SEQ} SELECT place_id, place_id || '_G' || gap_number AS gap_id, gap_number, gap_start AS gap_start_order, gap_end AS gap_end_order,
    s.phase_code AS gap_start_phase, e.phase_code AS gap_end_phase, gap_length, gap_number AS from_run, gap_number + 1 AS to_run
    FROM gaps JOIN phase s ON s.phase_order = gap_start JOIN phase e ON e.phase_order = gap_end""",
)
def gap_events(spark, d):
    return seq.gap_events(b.place_states(spark, d), "place_id")


# Q4, Q5, Q6
@query(
    "continuity_base",
    f"""{b.SQL_SEQ} SELECT place_id, pc AS presence_phase_count, first_order AS first_presence_order, last_order AS last_presence_order, span AS observed_span_phase_count,
    run_count, longest AS longest_run_length, round(mean_run, 6) AS mean_run_length, gap_count, gap_phases AS gap_phase_count, max_gap AS max_gap_length, round(mean_gap, 6) AS mean_gap_length,
    round(CASE WHEN span > 0 THEN pc / span::DOUBLE ELSE 0 END, 6) AS presence_density_in_span, round(penalty, 6) AS gap_penalty, round(gap_free, 6) AS gap_free_span_component, round(intermittency, 6) AS intermittency_index FROM scored""",
)
def continuity_base(spark, d):
    m = seq.metrics(b.place_states(spark, d))
    return m.select(
        "place_id", "presence_phase_count", "first_presence_order", "last_presence_order", "observed_span_phase_count", "run_count", "longest_run_length", r("mean_run_length"),
        "gap_count", "gap_phase_count", "max_gap_length", r("mean_gap_length"), r("presence_density_in_span"), r("gap_penalty"), r("gap_free_span_component"), r("intermittency_index"),
    )


# Q7, Q8: the flagship
@query("continuity_index", f"{b.SQL_SEQ} SELECT place_id, class_code AS sequence_class_code, sequence_class, round(continuity, 6) AS continuity_index FROM scored")
def continuity_index(spark, d):
    return seq.metrics(b.place_states(spark, d)).select("place_id", "sequence_class_code", "sequence_class", r("continuity_index"))


@query(
    "sequence_class_any_order",
    f"WITH {b.SQL_PRESENCE.replace(f" WHERE o_orderpriority = '{b.URGENT}'", '')}, {b.sql_metrics()} SELECT sequence_class, count(*) AS n_places, round(avg(continuity), 6) AS mean_continuity FROM scored GROUP BY 1",
)
def sequence_class_any_order(spark, d):
    m = seq.metrics(b.place_states(spark, d, any_order=True))
    return m.groupBy("sequence_class").agg(F.count("*").alias("n_places"), F.round(F.avg("continuity_index"), 6).alias("mean_continuity"))


_WEIGHTS = "weights AS (SELECT * FROM (VALUES ('baseline',0.35::DOUBLE,0.40::DOUBLE,0.25::DOUBLE),('balanced',1/3.0::DOUBLE,1/3.0::DOUBLE,1/3.0::DOUBLE),('coverage_heavy',0.50,0.30,0.20),('run_heavy',0.25,0.55,0.20),('gap_span_heavy',0.30,0.30,0.40)) t(weight_set, wp, wr, wg))"
_SCORES = f"""{b.SQL_SEQ}, {_WEIGHTS},
score AS (SELECT place_id, weight_set, round(CASE WHEN pc = 0 THEN 0.0 ELSE least(greatest(wp * pc / 7.0::DOUBLE + wr * longest / 7.0::DOUBLE + wg * gap_free, 0), 1) END, 9) AS ci FROM metrics CROSS JOIN weights),
ranked AS (SELECT *, rank() OVER (PARTITION BY weight_set ORDER BY ci DESC) AS rank_desc, greatest(1, ceil(count(*) OVER (PARTITION BY weight_set) * 0.1)) AS top_n FROM score)"""


def _scores(spark, d):
    """Index and rank of every place under each weight set; values are rounded before ranking so that ties are ties."""
    m = seq.metrics(b.place_states(spark, d))
    sets = F.array(*[F.struct(F.lit(n).alias("weight_set"), F.lit(p).alias("wp"), F.lit(q).alias("wr"), F.lit(g).alias("wg")) for n, p, q, g in seq.WEIGHT_SETS])
    spread = m.withColumn("w", F.explode(sets)).select("place_id", "w.weight_set", F.round(seq.continuity(F.col("w.wp"), F.col("w.wr"), F.col("w.wg")), 9).alias("ci"))
    return spread


# Ranks by counts of equal values, so that no window holds all places of a weight set
@query("continuity_index_weights", f"{_SCORES} SELECT place_id, weight_set, round(ci, 6) AS continuity_index, rank_desc, rank_desc <= top_n AS top_fraction FROM ranked")
def continuity_index_weights(spark, d):
    s = _scores(spark, d)
    return s.join(_rank_table(s), ["weight_set", "ci"]).select("place_id", "weight_set", F.round("ci", 6).alias("continuity_index"), "rank_desc", (F.col("rank_desc") <= F.col("top_n")).alias("top_fraction"))


def _rank_table(s):
    """(weight_set, ci, rank_desc, average_rank, top_n) for each different value of the index, of which there are few."""
    counts = s.groupBy("weight_set", "ci").agg(F.count("*").alias("n"))
    down = Window.partitionBy("weight_set").orderBy(F.desc("ci"))
    before = F.sum("n").over(down) - F.col("n")
    total = F.sum("n").over(Window.partitionBy("weight_set"))
    return counts.select("weight_set", "ci", (before + 1).alias("rank_desc"), (before + (F.col("n") + 1) / 2).alias("average_rank"), F.greatest(F.lit(1), F.ceil(total * 0.1)).alias("top_n"))


# Q9, A13, A14
@query(
    "weight_sensitivity",
    f"""{_SCORES}, avgr AS (SELECT *, rank_desc + (count(*) OVER (PARTITION BY weight_set, ci) - 1) / 2.0 AS ar, rank_desc <= top_n AS top FROM ranked),
    base2 AS (SELECT place_id, ar, top FROM avgr WHERE weight_set = 'baseline')
    SELECT a.weight_set, round(corr(a.ar, b.ar), 6) AS spearman, round(count(*) FILTER (a.top AND b.top) / (count(*) FILTER (a.top OR b.top))::DOUBLE, 6) AS jaccard_top
    FROM avgr a JOIN base2 b USING (place_id) GROUP BY a.weight_set""",
)
def weight_sensitivity(spark, d):
    s = _scores(spark, d)
    ranked = s.join(_rank_table(s), ["weight_set", "ci"]).withColumn("top", F.col("rank_desc") <= F.col("top_n"))
    base = F.max(F.when(F.col("weight_set") == "baseline", F.struct("average_rank", "top")))
    pairs = ranked.groupBy("place_id").agg(base.alias("b"), F.collect_list(F.struct("weight_set", "average_rank", "top")).alias("all")).select("b", F.explode("all").alias("a"))
    return pairs.groupBy(F.col("a.weight_set").alias("weight_set")).agg(
        F.round(F.corr("a.average_rank", "b.average_rank"), 6).alias("spearman"),
        F.round(F.count_if(F.col("a.top") & F.col("b.top")) / F.count_if(F.col("a.top") | F.col("b.top")), 6).alias("jaccard_top"),
    )


@query(
    "weight_place_sensitivity",
    f"{_SCORES} SELECT place_id, round(avg(ci), 6) AS mean_index, round(stddev_samp(ci), 6) AS sd_index, round(min(ci), 6) AS min_index, round(max(ci), 6) AS max_index, round(max(ci) - min(ci), 6) AS range_index FROM score GROUP BY place_id",
)
def weight_place_sensitivity(spark, d):
    return _scores(spark, d).groupBy("place_id").agg(
        F.round(F.avg("ci"), 6).alias("mean_index"), F.round(F.stddev_samp("ci"), 6).alias("sd_index"), F.round(F.min("ci"), 6).alias("min_index"),
        F.round(F.max("ci"), 6).alias("max_index"), F.round(F.max("ci") - F.min("ci"), 6).alias("range_index"),
    )


# Q10: tri-state domain metrics
_DOMAIN_METRICS = f"""WITH {b.SQL_DOMAIN}, unres AS (SELECT place_id, activity_domain, sum((presence IS NULL)::INT)::BIGINT AS unresolved, coalesce(sum(presence), 0)::BIGINT AS confirmed FROM domain GROUP BY ALL),
resolved AS (SELECT d.* FROM domain d JOIN unres u ON d.place_id = u.place_id AND d.activity_domain = u.activity_domain AND u.unresolved = 0), {b.sql_metrics("resolved", "place_id, activity_domain")},
dm AS (SELECT u.place_id, u.activity_domain, CASE WHEN u.unresolved > 0 THEN 'temporally_unresolved' ELSE 'resolved' END AS sequence_resolution, u.unresolved, u.confirmed, s.pc, s.run_count, s.longest, s.gap_count, s.max_gap, s.continuity, s.intermittency
 FROM unres u LEFT JOIN scored s ON u.place_id = s.place_id AND u.activity_domain = s.activity_domain)"""


@query(
    "domain_metrics",
    f"{_DOMAIN_METRICS} SELECT place_id, activity_domain, sequence_resolution, unresolved AS unresolved_phase_count, confirmed AS confirmed_presence_phase_count, pc AS presence_phase_count, run_count, longest AS longest_run_length, gap_count, max_gap AS max_gap_length, round(continuity, 6) AS continuity_index, round(intermittency, 6) AS intermittency_index FROM dm",
)
def domain_metrics(spark, d):
    return seq.metrics(b.domain_states(spark, d)).select(
        "place_id", "activity_domain", "sequence_resolution", "unresolved_phase_count", "confirmed_presence_phase_count", "presence_phase_count", "run_count", "longest_run_length", "gap_count", "max_gap_length", r("continuity_index"), r("intermittency_index"),
    )


# Q11
@query(
    "domain_consistency",
    f"""{_DOMAIN_METRICS.replace("resolved AS (", "resolved AS (", 1)}, main AS (SELECT place_id, sum(presence)::BIGINT AS main_count FROM (SELECT c.c_custkey AS place_id, p.phase_order, CASE WHEN s.place_id IS NULL THEN 0 ELSE 1 END AS presence
      FROM customer c CROSS JOIN phase p LEFT JOIN (SELECT DISTINCT o_custkey AS place_id, year(o_orderdate) - 1994 AS phase_order FROM orders WHERE o_orderpriority = '{b.URGENT}') s ON s.place_id = c.c_custkey AND s.phase_order = p.phase_order) GROUP BY place_id)
    SELECT sequence_resolution, count(*) AS n_places, count(*) FILTER (pc = main_count) AS n_equal, count(*) FILTER (pc IS NULL) AS n_unknown FROM dm JOIN main USING (place_id) WHERE activity_domain = '{b.URGENT}' GROUP BY 1""",
)
def domain_consistency(spark, d):
    main = seq.metrics(b.place_states(spark, d)).select("place_id", F.col("presence_phase_count").alias("main_count"))
    dom = seq.metrics(b.domain_states(spark, d).where(F.col("activity_domain") == b.URGENT))
    return dom.join(main, "place_id").groupBy("sequence_resolution").agg(
        F.count("*").alias("n_places"), F.count_if(F.col("presence_phase_count") == F.col("main_count")).alias("n_equal"), F.count_if(F.col("presence_phase_count").isNull()).alias("n_unknown")
    )


# Q12, A5
@query(
    "run_gap_by_domain",
    f"""{_DOMAIN_METRICS} SELECT activity_domain, count(*) AS n_places, count(pc) AS n_resolved, round(count(pc) / count(*)::DOUBLE, 6) AS resolution_rate, median(run_count)::DOUBLE AS median_run_count,
    median(longest)::DOUBLE AS median_longest_run, round(avg(longest), 6) AS mean_longest_run, round(avg((gap_count > 0)::INT), 6) AS gap_place_rate, round(median(continuity), 6) AS median_continuity,
    CASE WHEN count(pc) >= 20 THEN 'analyzed' ELSE 'insufficient_resolved_places' END AS status FROM dm GROUP BY activity_domain""",
)
def run_gap_by_domain(spark, d):
    return _run_gap(seq.metrics(b.domain_states(spark, d)), "activity_domain")


def _run_gap(m, *keys):
    n = F.count("presence_phase_count")
    return m.groupBy(*keys).agg(
        F.count("*").alias("n_places"), n.alias("n_resolved"), F.round(n / F.count("*"), 6).alias("resolution_rate"), F.median("run_count").alias("median_run_count"),
        F.median("longest_run_length").alias("median_longest_run"), F.round(F.avg("longest_run_length"), 6).alias("mean_longest_run"),
        F.round(F.avg((F.col("gap_count") > 0).cast("int")), 6).alias("gap_place_rate"), F.round(F.median("continuity_index"), 6).alias("median_continuity"),
        F.when(n >= 20, "analyzed").otherwise("insufficient_resolved_places").alias("status"),
    )


@query(
    "run_gap_by_landscape",
    f"""{b.SQL_SEQ}, {b.SQL_PLACE} SELECT scheme, unit_id, count(*) AS n_places, count(pc) AS n_resolved, 1.0::DOUBLE AS resolution_rate, median(run_count)::DOUBLE AS median_run_count,
    median(longest)::DOUBLE AS median_longest_run, round(avg(longest), 6) AS mean_longest_run, round(avg((gap_count > 0)::INT), 6) AS gap_place_rate, round(median(continuity), 6) AS median_continuity,
    CASE WHEN count(pc) >= 20 THEN 'analyzed' ELSE 'insufficient_resolved_places' END AS status FROM scored JOIN member USING (place_id) WHERE unit_id IS NOT NULL GROUP BY 1, 2""",
)
def run_gap_by_landscape(spark, d):
    return _run_gap(seq.metrics(b.place_states(spark, d)).join(b.membership(spark, d), "place_id"), "scheme", "unit_id")


# Q13
@query("landscape_membership", f"WITH {b.SQL_PLACE} SELECT DISTINCT place_id, scheme, unit_id FROM member WHERE unit_id IS NOT NULL")
def landscape_membership(spark, d):
    return b.membership(spark, d).distinct()


# Q14
@query("pattern_frequency", f"WITH {b.SQL_PRESENCE} SELECT sequence, count(*) AS n_places FROM (SELECT place_id, string_agg(presence::VARCHAR, '' ORDER BY phase_order) AS sequence FROM presence GROUP BY place_id) GROUP BY sequence")
def pattern_frequency(spark, d):
    return b.place_states(spark, d).groupBy(seq.sequence_string(F.col("states")).alias("sequence")).agg(F.count("*").alias("n_places"))


# Patterns are at most 127, whatever the number of places
@query("sequence_clusters")
def sequence_clusters(spark, d):
    return cluster.sequence_clusters(b.place_states(spark, d))


@query("sequence_cluster_profile")
def sequence_cluster_profile(spark, d):
    return cluster.profile(seq.metrics(b.place_states(spark, d)), cluster.sequence_clusters(b.place_states(spark, d)))


_TRANS = f"""WITH {b.SQL_PRESENCE}, nxt AS (SELECT *, lead(presence) OVER w AS to_state, lead(phase_code) OVER w AS to_phase FROM presence WINDOW w AS (PARTITION BY place_id ORDER BY phase_order)),
trans AS (SELECT place_id, phase_order AS phase_pair_order, phase_code || '->' || to_phase AS phase_pair, presence AS from_state, to_state,
 CASE WHEN presence = 1 AND to_state = 1 THEN 'continue' WHEN presence = 1 THEN 'drop' WHEN to_state = 1 THEN 'new' ELSE 'apparent_absence_continue' END AS transition FROM nxt WHERE to_phase IS NOT NULL)"""


# Q18, W1, W2
@query("transition_long", f"{_TRANS} SELECT * FROM trans")
def transition_long(spark, d):
    return seq.transitions(b.place_states(spark, d))


_PAIRS = [f"{a}->{z}" for a, z in zip(seq.PHASES, seq.PHASES[1:], strict=False)]


def _grid(spark, **lists):
    """All combinations of literal lists, as one small literal table."""
    frame = spark.range(1).drop("id")
    for name, values in lists.items():
        frame = frame.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return frame


# Q19, W3, J5
@query(
    "active_transition_share",
    f"""{_TRANS}, grid AS (SELECT * FROM (SELECT DISTINCT phase_pair, phase_pair_order FROM trans) CROSS JOIN (VALUES ('continue'),('drop'),('new')) k(transition)),
    cnt AS (SELECT phase_pair, transition, count(*) AS n FROM trans WHERE transition <> 'apparent_absence_continue' GROUP BY ALL)
    SELECT g.phase_pair_order, g.phase_pair, g.transition, coalesce(n, 0) AS n_transitions, sum(coalesce(n, 0)) OVER (PARTITION BY g.phase_pair)::BIGINT AS active_total,
    round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.phase_pair), 0)::DOUBLE, 6) AS active_share FROM grid g LEFT JOIN cnt c ON c.phase_pair = g.phase_pair AND c.transition = g.transition""",
)
def active_transition_share(spark, d):
    counts = seq.transitions(b.place_states(spark, d)).where("transition <> 'apparent_absence_continue'").groupBy("phase_pair", "transition").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, _PAIRS)), F.col("phase_pair")).cast("int")
    grid = _grid(spark, phase_pair=_PAIRS, transition=("continue", "drop", "new")).withColumn("phase_pair_order", order)
    full = grid.join(counts, ["phase_pair", "transition"], "left").withColumn("n_transitions", F.coalesce("n", F.lit(0)))
    total = F.sum("n_transitions").over(Window.partitionBy("phase_pair"))
    return full.select("phase_pair_order", "phase_pair", "transition", "n_transitions", total.alias("active_total"), F.round(F.try_divide(F.col("n_transitions"), total), 6).alias("active_share"))


_DTRANS = f"""WITH {b.SQL_DOMAIN}, nxt AS (SELECT *, lead(presence) OVER w AS to_state, lead(phase_code) OVER w AS to_phase FROM domain WINDOW w AS (PARTITION BY place_id, activity_domain ORDER BY phase_order)),
dtrans AS (SELECT place_id, activity_domain, phase_order AS phase_pair_order, phase_code || '->' || to_phase AS phase_pair, presence AS from_state, to_state,
 CASE WHEN presence IS NULL OR to_state IS NULL THEN 'temporally_unresolved_transition' WHEN presence = 1 AND to_state = 1 THEN 'continue' WHEN presence = 1 THEN 'drop' WHEN to_state = 1 THEN 'new' ELSE 'apparent_absence_continue' END AS transition FROM nxt WHERE to_phase IS NOT NULL)"""


# Q20
@query(
    "domain_transition_resolution",
    f"""{_DTRANS} SELECT activity_domain, phase_pair, count(*) AS n_pairs, count(*) FILTER (transition <> 'temporally_unresolved_transition') AS n_resolved,
    round(count(*) FILTER (transition <> 'temporally_unresolved_transition') / count(*)::DOUBLE, 6) AS resolution_rate FROM dtrans GROUP BY ALL""",
)
def domain_transition_resolution(spark, d):
    known = F.count_if(F.col("transition") != "temporally_unresolved_transition")
    t = seq.transitions(b.domain_states(spark, d), unresolved=True)
    return t.groupBy("activity_domain", "phase_pair").agg(F.count("*").alias("n_pairs"), known.alias("n_resolved"), F.round(known / F.count("*"), 6).alias("resolution_rate"))


@query("domain_transition_counts", f"{_DTRANS} SELECT activity_domain, phase_pair, transition, count(*) AS n_transitions FROM dtrans GROUP BY ALL")
def domain_transition_counts(spark, d):
    return seq.transitions(b.domain_states(spark, d), unresolved=True).groupBy("activity_domain", "phase_pair", "transition").agg(F.count("*").alias("n_transitions"))


def _markov(spark, t, *keys, grid):
    counts = t.groupBy(*keys, "from_state", "to_state").agg(F.count("*").alias("n"))
    full = grid.join(counts, [*keys, "from_state", "to_state"], "left").withColumn("n_transitions", F.coalesce("n", F.lit(0)))
    total = F.sum("n_transitions").over(Window.partitionBy(*keys, "from_state"))
    return full.select(*keys, "from_state", "to_state", "n_transitions", F.round(F.try_divide(F.col("n_transitions"), total), 6).alias("probability"))


_STATES = "(VALUES (0),(1)) a(from_state) CROSS JOIN (VALUES (0),(1)) z(to_state)"


# Q21
@query(
    "markov_by_pair",
    f"""{_TRANS}, cnt AS (SELECT phase_pair, from_state, to_state, count(*) AS n FROM trans GROUP BY ALL), grid AS (SELECT * FROM (SELECT DISTINCT phase_pair FROM trans) CROSS JOIN {_STATES})
    SELECT g.phase_pair, g.from_state, g.to_state, coalesce(n, 0) AS n_transitions, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.phase_pair, g.from_state), 0)::DOUBLE, 6) AS probability
    FROM grid g LEFT JOIN cnt c ON c.phase_pair = g.phase_pair AND c.from_state = g.from_state AND c.to_state = g.to_state""",
)
def markov_by_pair(spark, d):
    return _markov(spark, seq.transitions(b.place_states(spark, d)), "phase_pair", grid=_grid(spark, phase_pair=_PAIRS, from_state=(0, 1), to_state=(0, 1)))


@query("markov_overall", f"{_TRANS} SELECT from_state, to_state, count(*) AS n_transitions, round(count(*) / sum(count(*)) OVER (PARTITION BY from_state)::DOUBLE, 6) AS probability FROM trans GROUP BY from_state, to_state")
def markov_overall(spark, d):
    return _markov(spark, seq.transitions(b.place_states(spark, d)), grid=_grid(spark, from_state=(0, 1), to_state=(0, 1))).where("n_transitions > 0")


# Q22
@query(
    "domain_markov",
    f"""{_DTRANS}, ok AS (SELECT * FROM dtrans WHERE transition <> 'temporally_unresolved_transition'), cnt AS (SELECT activity_domain, phase_pair, from_state, to_state, count(*) AS n FROM ok GROUP BY ALL),
    grid AS (SELECT * FROM dom CROSS JOIN (SELECT DISTINCT phase_pair FROM dtrans) CROSS JOIN {_STATES})
    SELECT g.*, coalesce(n, 0) AS n_transitions, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.activity_domain, g.phase_pair, g.from_state), 0)::DOUBLE, 6) AS probability
    FROM grid g LEFT JOIN cnt c ON c.activity_domain = g.activity_domain AND c.phase_pair = g.phase_pair AND c.from_state = g.from_state AND c.to_state = g.to_state""",
)
def domain_markov(spark, d):
    t = seq.transitions(b.domain_states(spark, d))
    domains = b.order_facts(spark, d).select("activity_domain").distinct()
    grid = domains.crossJoin(F.broadcast(_grid(spark, phase_pair=_PAIRS, from_state=(0, 1), to_state=(0, 1))))
    return _markov(spark, t, "activity_domain", "phase_pair", grid=grid)


# Q23
@query("domain_presence_rate", f"WITH {b.SQL_DOMAIN} SELECT activity_domain, phase_code, count(*) AS n_places, count(presence) AS n_resolved, sum(presence)::BIGINT AS n_present, round(sum(presence) / nullif(count(presence), 0)::DOUBLE, 6) AS presence_rate FROM domain GROUP BY ALL")
def domain_presence_rate(spark, d):
    return seq.long(b.domain_states(spark, d)).groupBy("activity_domain", "phase_code").agg(
        F.count("*").alias("n_places"), F.count("presence").alias("n_resolved"), F.sum("presence").alias("n_present"), F.round(F.try_divide(F.sum("presence"), F.count("presence")), 6).alias("presence_rate")
    )


# Q24, Q25: break screening of four series for each domain
_SERIES = f"""{_DTRANS}, series AS (SELECT activity_domain, 'presence_rate' AS metric, phase_order AS pos, phase_code AS label, sum(presence) / nullif(count(presence), 0)::DOUBLE AS value FROM domain GROUP BY ALL
 UNION ALL SELECT activity_domain, t.metric, phase_pair_order, phase_pair, count(*) FILTER (transition = t.kind) / nullif(count(*) FILTER (transition IN ('continue','drop','new')), 0)::DOUBLE
 FROM dtrans CROSS JOIN (VALUES ('continue','continue_share'),('drop','drop_share'),('new','new_share')) t(kind, metric) GROUP BY ALL),
val AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY activity_domain, metric) AS n FROM series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY activity_domain, metric ORDER BY pos)),
cand AS (SELECT a.activity_domain, a.metric, a.i AS candidate_order, any_value(a.label) AS left_label, max(CASE WHEN z.i = a.i + 1 THEN z.label END) AS right_label,
 avg(z.value) FILTER (z.i <= a.i) AS left_mean, avg(z.value) FILTER (z.i > a.i) AS right_mean, var_pop(z.value) * count(*) AS sse0,
 var_pop(z.value) FILTER (z.i <= a.i) * a.i + var_pop(z.value) FILTER (z.i > a.i) * (count(*) - a.i) AS sse1
 FROM val a JOIN val z ON a.activity_domain = z.activity_domain AND a.metric = z.metric WHERE a.n >= 4 AND a.i BETWEEN 2 AND a.n - 2 GROUP BY a.activity_domain, a.metric, a.i),
sc AS (SELECT *, round(CASE WHEN sse0 > 1e-18 THEN (sse0 - sse1) / sse0 ELSE 0 END, 6) AS change_score FROM cand)"""


def _domain_series(spark, d):
    domains = b.domain_states(spark, d)
    rate = seq.long(domains).groupBy("activity_domain", F.lit("presence_rate").alias("metric"), F.col("phase_order").alias("at"), F.col("phase_code").alias("label")).agg(F.try_divide(F.sum("presence"), F.count("presence")).alias("value"))
    t = seq.transitions(domains).groupBy("activity_domain", F.col("phase_pair_order").alias("at"), F.col("phase_pair").alias("label"))
    active = F.count_if(F.col("transition") != "apparent_absence_continue")
    shares = t.agg(*[F.try_divide(F.count_if(F.col("transition") == k), active).alias(f"{k}_share") for k in ("continue", "drop", "new")])
    return rate.unionByName(shares.unpivot(["activity_domain", "at", "label"], ["continue_share", "drop_share", "new_share"], "metric", "value"))


@query("change_point_candidates", f"{_SERIES} SELECT activity_domain, metric, candidate_order, left_label, right_label, round(left_mean, 6) AS left_mean, round(right_mean, 6) AS right_mean, change_score FROM sc")
def change_point_candidates(spark, d):
    return breaks.candidates(_domain_series(spark, d), ["activity_domain", "metric"]).select(
        "activity_domain", "metric", "candidate_order", "left_label", "right_label", r("left_mean"), r("right_mean"), r("change_score")
    )


# The first of equal scores wins; clarity is best minus second
@query(
    "change_point_best",
    f"""{_SERIES}, rk AS (SELECT *, row_number() OVER w AS k, lead(change_score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY activity_domain, metric ORDER BY change_score DESC, candidate_order))
    SELECT activity_domain, metric, candidate_order, change_score, round(change_score - second, 6) AS break_clarity FROM rk WHERE k = 1""",
)
def change_point_best(spark, d):
    found = breaks.candidates(_domain_series(spark, d), ["activity_domain", "metric"]).withColumn("change_score", F.round("change_score", 6))
    return breaks.best(found, ["activity_domain", "metric"]).select("activity_domain", "metric", "candidate_order", "change_score", r("break_clarity"))


# Q26, Q27
@query(
    "landscape_presence",
    f"WITH {b.SQL_PRESENCE}, {b.SQL_PLACE} SELECT scheme, unit_id, phase_order, count(*) AS n_places, sum(presence)::BIGINT AS n_present, round(avg(presence), 6) AS presence_rate FROM presence JOIN member USING (place_id) WHERE unit_id IS NOT NULL GROUP BY ALL",
)
def landscape_presence(spark, d):
    s = b.membership(spark, d).join(b.place_states(spark, d), "place_id")
    return seq.long(s).groupBy("scheme", "unit_id", "phase_order").agg(F.count("*").alias("n_places"), F.sum("presence").alias("n_present"), F.round(F.avg("presence"), 6).alias("presence_rate"))


@query(
    "landscape_change_points",
    f"""WITH {b.SQL_PRESENCE}, {b.SQL_PLACE}, val AS (SELECT scheme, unit_id, phase_order AS i, avg(presence) AS value FROM presence JOIN member USING (place_id) WHERE unit_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 20),
    cand AS (SELECT a.scheme, a.unit_id, a.i AS candidate_order, var_pop(z.value) * count(*) AS sse0, var_pop(z.value) FILTER (z.i <= a.i) * a.i + var_pop(z.value) FILTER (z.i > a.i) * (count(*) - a.i) AS sse1
     FROM val a JOIN val z ON a.scheme = z.scheme AND a.unit_id = z.unit_id WHERE a.i BETWEEN 2 AND 5 GROUP BY a.scheme, a.unit_id, a.i),
    sc AS (SELECT *, round(CASE WHEN sse0 > 1e-18 THEN (sse0 - sse1) / sse0 ELSE 0 END, 6) AS change_score FROM cand),
    rk AS (SELECT *, row_number() OVER w AS k, lead(change_score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY scheme, unit_id ORDER BY change_score DESC, candidate_order))
    SELECT scheme, unit_id, candidate_order, change_score, round(change_score - second, 6) AS break_clarity FROM rk WHERE k = 1""",
)
def landscape_change_points(spark, d):
    s = seq.long(b.membership(spark, d).join(b.place_states(spark, d), "place_id"))
    rate = s.groupBy("scheme", "unit_id", F.col("phase_order").alias("at"), F.col("phase_code").alias("label")).agg(F.avg("presence").alias("value"), F.count("*").alias("n")).where("n >= 20")
    found = breaks.candidates(rate, ["scheme", "unit_id"]).withColumn("change_score", F.round("change_score", 6))
    return breaks.best(found, ["scheme", "unit_id"]).select("scheme", "unit_id", "candidate_order", "change_score", r("break_clarity"))


@query(
    "landscape_transition",
    f"{_TRANS}, {b.SQL_PLACE} SELECT scheme, unit_id, phase_pair, transition, count(*) AS n_transitions FROM trans JOIN member USING (place_id) WHERE unit_id IS NOT NULL AND transition <> 'apparent_absence_continue' GROUP BY ALL",
)
def landscape_transition(spark, d):
    t = seq.transitions(b.membership(spark, d).join(b.place_states(spark, d), "place_id"))
    return t.where("transition <> 'apparent_absence_continue'").groupBy("scheme", "unit_id", "phase_pair", "transition").agg(F.count("*").alias("n_transitions"))


# Trajectory of each landscape unit over the phases
@query(
    "unit_trajectory",
    f"""WITH {b.SQL_PRESENCE}, {b.SQL_PLACE}, cnt AS (SELECT scheme, unit_id, phase_order, phase_code, sum(presence)::BIGINT AS n FROM presence JOIN member USING (place_id) WHERE unit_id IS NOT NULL GROUP BY ALL),
    sh AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY scheme, phase_order), 0)::DOUBLE AS share FROM cnt),
    peak AS (SELECT scheme, unit_id, phase_code AS peak_phase, row_number() OVER (PARTITION BY scheme, unit_id ORDER BY n DESC, phase_order) AS k FROM cnt)
    SELECT s.scheme, s.unit_id, sum(n)::BIGINT AS total_records, round(avg(n), 6) AS mean_count, round(stddev_samp(n), 6) AS sd_count, max(n) AS max_count, any_value(p.peak_phase) AS peak_phase,
    round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share, count(*) FILTER (n > 0) AS active_phase_count, sum(n) >= 20 AS eligible
    FROM sh s JOIN peak p ON p.scheme = s.scheme AND p.unit_id = s.unit_id AND p.k = 1 GROUP BY s.scheme, s.unit_id""",
)
def unit_trajectory(spark, d):
    s = seq.long(b.membership(spark, d).join(b.place_states(spark, d), "place_id"))
    counts = s.groupBy("scheme", "unit_id", "phase_order", "phase_code").agg(F.sum("presence").alias("n"))
    shares = counts.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("scheme", "phase_order"))))
    return shares.groupBy("scheme", "unit_id").agg(
        F.sum("n").alias("total_records"), F.round(F.avg("n"), 6).alias("mean_count"), F.round(F.stddev_samp("n"), 6).alias("sd_count"), F.max("n").alias("max_count"),
        F.max(F.struct("n", (-F.col("phase_order")).alias("o"), "phase_code"))["phase_code"].alias("peak_phase"), F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.max("share"), 6).alias("max_share"),
        F.count_if(F.col("n") > 0).alias("active_phase_count"), (F.sum("n") >= 20).alias("eligible"),
    )


# Q29
@query(
    "transition_geography",
    f"""{_TRANS}, {b.SQL_PLACE}, act AS (SELECT scheme, unit_id, phase_pair, count(*) AS n_active, count(*) FILTER (transition = 'continue') AS c, count(*) FILTER (transition = 'drop') AS dd, count(*) FILTER (transition = 'new') AS nw
      FROM trans JOIN member USING (place_id) WHERE unit_id IS NOT NULL AND transition <> 'apparent_absence_continue' GROUP BY ALL),
    ev AS (SELECT scheme, unit_id, phase_pair, n_active, t.event, CASE t.event WHEN 'continue' THEN c WHEN 'drop' THEN dd ELSE nw END AS n_event FROM act CROSS JOIN (VALUES ('continue'),('drop'),('new')) t(event)),
    sh AS (SELECT *, n_event / nullif(sum(n_event) OVER (PARTITION BY scheme, phase_pair, event), 0)::DOUBLE AS es, n_active / (sum(n_active) OVER (PARTITION BY scheme, phase_pair, event))::DOUBLE AS act_s FROM ev)
    SELECT scheme, unit_id, phase_pair, event, n_event, n_active, round(es, 6) AS event_share, round(act_s, 6) AS active_share, round(es - act_s, 6) AS share_difference, round(es / act_s, 6) AS share_ratio, n_active >= 20 AS eligible FROM sh""",
)
def transition_geography(spark, d):
    t = seq.transitions(b.membership(spark, d).join(b.place_states(spark, d), "place_id")).where("transition <> 'apparent_absence_continue'")
    counts = t.groupBy("scheme", "unit_id", "phase_pair").agg(F.count("*").alias("n_active"), *[F.count_if(F.col("transition") == k).alias(k) for k in ("continue", "drop", "new")])
    events = counts.unpivot(["scheme", "unit_id", "phase_pair", "n_active"], ["continue", "drop", "new"], "event", "n_event")
    w = Window.partitionBy("scheme", "phase_pair", "event")
    shares = events.withColumns({"es": F.try_divide(F.col("n_event"), F.sum("n_event").over(w)), "acts": F.col("n_active") / F.sum("n_active").over(w)})
    return shares.select(
        "scheme", "unit_id", "phase_pair", "event", "n_event", "n_active", F.round("es", 6).alias("event_share"), F.round("acts", 6).alias("active_share"),
        F.round(F.col("es") - F.col("acts"), 6).alias("share_difference"), F.round(F.col("es") / F.col("acts"), 6).alias("share_ratio"), (F.col("n_active") >= 20).alias("eligible"),
    )


# Q30
@query(
    "retention_rate",
    f"""{_TRANS}, {b.SQL_PLACE} SELECT scheme, unit_id, phase_pair, count(*) FILTER (transition = 'continue') AS n_continue, count(*) FILTER (transition = 'drop') AS n_drop,
    round(count(*) FILTER (transition = 'continue') / nullif(count(*) FILTER (from_state = 1), 0)::DOUBLE, 6) AS retention_rate, round(count(*) FILTER (transition = 'drop') / nullif(count(*) FILTER (from_state = 1), 0)::DOUBLE, 6) AS drop_rate
    FROM trans JOIN member USING (place_id) WHERE unit_id IS NOT NULL GROUP BY ALL""",
)
def retention_rate(spark, d):
    t = seq.transitions(b.membership(spark, d).join(b.place_states(spark, d), "place_id"))
    c, x = F.count_if(F.col("transition") == "continue"), F.count_if(F.col("transition") == "drop")
    return t.groupBy("scheme", "unit_id", "phase_pair").agg(c.alias("n_continue"), x.alias("n_drop"), F.round(F.try_divide(c, c + x), 6).alias("retention_rate"), F.round(F.try_divide(x, c + x), 6).alias("drop_rate"))


# BH over a family of tests, and rank correlation with ties
@query(
    "bh_adjust",
    """WITH t AS (SELECT p_brand, p_type, count(*) AS n, CASE WHEN avg(p_size) > 25 THEN round(1 / (1 + count(*)::DOUBLE), 6) WHEN count(*) > 1 THEN round(1 / (2 + sum(p_size)::DOUBLE), 6) END AS p FROM part GROUP BY ALL),
    r AS (SELECT *, count(p) OVER (PARTITION BY p_brand) AS m, count(p) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM t WHERE p IS NOT NULL)
    SELECT p_brand, p_type, p, round(least(1, min(p * m / k) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_bh FROM r UNION ALL SELECT p_brand, p_type, p, NULL FROM t WHERE p IS NULL""",
)
def bh_adjust(spark, d):
    t = b.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.avg("p_size").alias("m"), F.sum("p_size").alias("s"))
    p = F.when(F.col("m") > 25, F.round(1 / (1 + F.col("n")), 6)).when(F.col("n") > 1, F.round(1 / (2 + F.col("s")), 6))
    return stats.with_bh(t.select("p_brand", "p_type", p.alias("p")), "p", "p_bh", "p_brand").withColumn("p_bh", F.round("p_bh", 6))


# W14
@query(
    "spearman_ties",
    """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS z FROM part)
    SELECT p_brand, count(*) AS n_pairs, round(corr(a, z), 6) AS spearman FROM r GROUP BY p_brand""",
)
def spearman_ties(spark, d):
    return stats.spearman(b.table(spark, d, "part"), "p_size", "p_retailprice", "p_brand").withColumn("spearman", F.round("spearman", 6))
