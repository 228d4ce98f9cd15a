"""Activity domains of places from market segments (tokens) and tagged order texts.

The tokens of a customer are the segment and the nation; the texts are made of urgent
and high orders: a phase tag and a kind of feature that follows from the order key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import classify
from strandline.operators import sequence as seq
from strandline.plans import bindings as b
from strandline.plans.registry import query

DICTIONARY = [
    ("BUILDING", "general_activity", "explicit_general", "Pa;Jo;Ya;Ko;Na;He;Me"), ("MACHINERY", "production", "specialized", "Ko;Na;He;Me"), ("AUTOMOBILE", "monument", "specialized", "Ya;Ko;Me"),
    ("FURNITURE", "institutional", "specialized", "Na;He;Me"), ("HOUSEHOLD", "general_activity", "neutral", "Pa;Jo"),
]
RULES = tuple((p, f"^{p}$") for p in seq.PHASES)
FEATURES = (("general_activity", "house|shellmound", "Pa;Jo;Ya;Ko;Na;He;Me"), ("monument", "tomb|(?<!shell)mound", "Ya;Ko;Me"), ("institutional", "temple", "Na;He;Me"), ("production", "kiln", "Ko;Na;He;Me"))
_WORDS = ("kiln", "temple", "mound", "shellmound", "tomb", "nothing")


def _dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "token string, activity_domain string, evidence_role string, allowed_phases string")


def _places(spark, d):
    o = b.table(spark, d, "orders").where("o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("o_orderkey") % len(_WORDS) + 1).cast("int"))
    phase = F.element_at(F.array(*map(F.lit, seq.PHASES)), F.year("o_orderdate") - 1994)
    segment = F.concat(F.lit("["), phase, F.lit("]"), word)
    texts = o.groupBy(F.col("o_custkey").alias("place_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", segment.alias("s")))), lambda x: x["s"]), "").alias("features"))
    rows = b.place_states(spark, d).join(b.places(spark, d).select("place_id", F.array("landform", "unit_basin").alias("tokens")), "place_id")
    return rows.join(texts, "place_id", "left").withColumn("features", F.coalesce("features", F.lit("")))


def _evidence(spark, d):
    places = _places(spark, d)
    return places, classify.token_evidence(places, _dictionary(spark)).unionByName(classify.tagged_evidence(places, rules=RULES, features=FEATURES)).unionByName(classify.untagged_evidence(places, features=FEATURES))


_DICT = "dict AS (SELECT * FROM (VALUES " + ",".join(str(r) for r in DICTIONARY) + ") t(token, activity_domain, evidence_role, allowed_phases))"
_BASE = f"""WITH {b.SQL_PRESENCE}, {b.SQL_PLACE}, {_DICT}, observed AS (SELECT place_id, coalesce(list(phase_code ORDER BY phase_order) FILTER (presence = 1), []) AS obs FROM presence GROUP BY 1),
token AS (SELECT place_id, landform AS token FROM place UNION ALL SELECT place_id, unit_basin FROM place),
tev AS (SELECT place_id, activity_domain, 'token' AS source, list_intersect(obs, string_split(allowed_phases, ';')) AS compatible FROM token JOIN dict USING (token) JOIN observed USING (place_id) WHERE evidence_role <> 'neutral'),
seg AS (SELECT o_custkey AS place_id, (['Pa','Jo','Ya','Ko','Na','He','Me'])[year(o_orderdate) - 1994] AS phase, (['kiln','temple','mound','shellmound','tomb','nothing'])[o_orderkey % 6 + 1] AS body FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'),
feat AS (SELECT * FROM (VALUES ('general_activity','shellmound','Pa;Jo;Ya;Ko;Na;He;Me'),('monument','tomb','Ya;Ko;Me'),('monument','mound','Ya;Ko;Me'),('institutional','temple','Na;He;Me'),('production','kiln','Ko;Na;He;Me')) t(activity_domain, word, allowed)),
gev AS (SELECT place_id, activity_domain, 'tagged' AS source, CASE WHEN list_contains(string_split(allowed, ';'), phase) AND list_contains(obs, phase) THEN [phase] ELSE [] END AS compatible FROM seg JOIN feat ON word = body JOIN observed USING (place_id)),
ev AS (SELECT *, CASE len(compatible) WHEN 1 THEN 'present' WHEN 0 THEN 'incompatible' ELSE 'temporally_ambiguous' END AS assignment_status FROM (SELECT * FROM tev UNION ALL SELECT * FROM gev))"""
_STATUS = f"""{_BASE}, sp AS (SELECT DISTINCT place_id, activity_domain, assignment_status, unnest(compatible) AS phase_code FROM ev), g AS (SELECT p.place_id, p.phase_order, p.phase_code, p.presence, t.activity_domain FROM presence p CROSS JOIN (VALUES ('general_activity'),('monument'),('institutional'),('production')) t(activity_domain)),
f AS (SELECT g.*, EXISTS (SELECT 1 FROM sp WHERE sp.place_id = g.place_id AND sp.phase_code = g.phase_code AND sp.activity_domain = g.activity_domain AND assignment_status = 'present') AS direct,
  EXISTS (SELECT 1 FROM sp WHERE sp.place_id = g.place_id AND sp.phase_code = g.phase_code AND sp.activity_domain = g.activity_domain AND assignment_status = 'temporally_ambiguous') AS amb,
  EXISTS (SELECT 1 FROM sp WHERE sp.place_id = g.place_id AND sp.phase_code = g.phase_code AND sp.activity_domain <> 'general_activity' AND assignment_status = 'present') AS spp,
  EXISTS (SELECT 1 FROM sp WHERE sp.place_id = g.place_id AND sp.phase_code = g.phase_code AND sp.activity_domain <> 'general_activity' AND assignment_status = 'temporally_ambiguous') AS spo FROM g),
st AS (SELECT place_id, phase_order, phase_code, activity_domain, presence AS phase_presence, CASE WHEN presence = 0 THEN 'apparent_absence' WHEN activity_domain = 'general_activity' THEN CASE WHEN direct THEN 'present_general_explicit' WHEN spp AND amb THEN 'temporally_ambiguous_general_candidate'
  WHEN spp THEN 'excluded_specialized_only' WHEN spo THEN 'temporally_ambiguous_due_to_specialized' ELSE 'present_general_default' END WHEN direct THEN 'present' WHEN amb THEN 'temporally_ambiguous' ELSE 'no_positive_domain_evidence' END AS domain_status FROM f),
sta AS (SELECT *, CASE WHEN domain_status LIKE 'present%' THEN 1 WHEN domain_status LIKE 'temporally_ambiguous%' THEN NULL ELSE 0 END AS domain_presence FROM st)"""


# K1
@query("token_dictionary_audit", f"{_BASE} SELECT token, count(*) AS n_records, 0 AS bracket_balance FROM token WHERE token NOT IN (SELECT token FROM dict) GROUP BY 1")
def token_dictionary_audit(spark, d):
    return classify.token_audit(_places(spark, d).select(F.explode("tokens").alias("token")), _dictionary(spark))


# K2
@query("token_evidence", f"{_BASE} SELECT place_id, activity_domain, source, assignment_status, len(compatible) AS n_compatible FROM ev WHERE source = 'token'")
def token_evidence(spark, d):
    found = classify.token_evidence(_places(spark, d), _dictionary(spark))
    return found.select("place_id", "activity_domain", "source", "assignment_status", F.size("compatible").alias("n_compatible"))


# K3, J16, X6
@query("tagged_evidence", f"{_BASE} SELECT place_id, activity_domain, source, assignment_status, array_to_string(compatible, ';') AS phases FROM ev WHERE source = 'tagged'")
def tagged_evidence(spark, d):
    found = classify.tagged_evidence(_places(spark, d), rules=RULES, features=FEATURES)
    return found.select("place_id", "activity_domain", "source", "assignment_status", F.array_join("compatible", ";").alias("phases"))


@query(
    "tagged_segments",
    """SELECT o_custkey AS place_id, (['Pa','Jo','Ya','Ko','Na','He','Me'])[year(o_orderdate) - 1994] AS tag, (['kiln','temple','mound','shellmound','tomb','nothing'])[o_orderkey % 6 + 1] AS body FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'""",
)
def tagged_segments(spark, d):
    return _places(spark, d).select("place_id", F.explode(tx.tagged_segments(F.col("features"))).alias("s")).select("place_id", "s.tag", "s.body")


# K4: orders as places, seen in the phase of their year (in two phases if their status is open); every fourth text is tagged
@query(
    "untagged_evidence",
    """WITH o AS (SELECT o_orderkey AS place_id, (['Pa','Jo','Ya','Ko','Na','He','Me'])[year(o_orderdate) % 7 + 1] AS phase, (['kiln','temple','mound','shellmound','tomb','nothing'])[o_orderkey % 6 + 1] AS body FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 4 <> 0),
    feat AS (SELECT * FROM (VALUES ('general_activity','shellmound','Pa;Jo;Ya;Ko;Na;He;Me'),('monument','tomb','Ya;Ko;Me'),('monument','mound','Ya;Ko;Me'),('institutional','temple','Na;He;Me'),('production','kiln','Ko;Na;He;Me')) t(activity_domain, word, allowed))
    SELECT place_id, activity_domain, 'untagged' AS source, CASE WHEN list_contains(string_split(allowed, ';'), phase) THEN 'present' ELSE 'incompatible' END AS assignment_status, CASE WHEN list_contains(string_split(allowed, ';'), phase) THEN phase ELSE '' END AS phases FROM o JOIN feat ON word = body""",
)
def untagged_evidence(spark, d):
    i = F.year("o_orderdate") % 7
    seen = lambda p: (F.lit(p) == i) | ((F.col("o_orderstatus") == "P") & (F.lit(p) == (i + 1) % 7))
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("o_orderkey") % len(_WORDS) + 1).cast("int"))
    places = b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("place_id"), F.array(*[seen(p).cast("int") for p in range(len(seq.PHASES))]).alias("states"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("[Ko]"), word)).otherwise(word).alias("features"),
    )
    found = classify.untagged_evidence(places, features=FEATURES)
    return found.select("place_id", "activity_domain", "source", "assignment_status", F.array_join("compatible", ";").alias("phases"))


# K5
@query("domain_status", f"{_STATUS} SELECT place_id, phase_order, phase_code, activity_domain, phase_presence, domain_presence, domain_status FROM sta")
def domain_status(spark, d):
    places, evidence = _evidence(spark, d)
    return classify.domain_status(places, evidence)


# K6, A25
_CELLS = ", ".join(f"max(domain_presence) FILTER (activity_domain = '{x}' AND phase_code = '{p}') AS {x}_{p}" for x in classify.DOMAINS for p in seq.PHASES)
_ANYS = ", ".join(f"CASE WHEN max(domain_presence) FILTER (activity_domain = '{x}') = 1 THEN 1 WHEN count(*) FILTER (activity_domain = '{x}' AND domain_presence IS NULL) > 0 THEN NULL ELSE 0 END AS {x}_any" for x in classify.DOMAINS)


@query("domain_flags_wide", f"{_STATUS} SELECT place_id, {_CELLS}, {_ANYS} FROM sta GROUP BY place_id")
def domain_flags_wide(spark, d):
    places, evidence = _evidence(spark, d)
    return classify.wide(classify.domain_status(places, evidence))


# K7
@query(
    "classification_audit",
    f"""{_STATUS}, um AS (SELECT token, count(*) AS n FROM token WHERE token NOT IN (SELECT token FROM dict) GROUP BY 1), a AS (SELECT
    (SELECT count(*) FROM observed) AS input_rows, (SELECT count(*) FROM ev WHERE assignment_status = 'present') AS direct_present_assignments, (SELECT count(*) FROM ev WHERE assignment_status = 'incompatible') AS incompatible_assignments,
    (SELECT count(*) FROM ev WHERE assignment_status = 'temporally_ambiguous') AS temporally_ambiguous_assignments, (SELECT count(DISTINCT place_id) FROM sta) AS output_rows, (SELECT count(*) FROM sta WHERE domain_presence IS NULL) AS domain_unresolved_phase_statuses,
    (SELECT count(*) FROM sta WHERE domain_status = 'temporally_ambiguous_due_to_specialized') AS general_unresolved_due_to_specialized_ambiguity, 0::BIGINT AS domain_presence_when_phase_absent, 0::BIGINT AS duplicate_row_phase_domain,
    (SELECT count(*) FROM um) AS unclassified_token_types, (SELECT sum(n)::BIGINT FROM um) AS unclassified_token_occurrences, 0::BIGINT AS unbalanced_parenthesis_token_types) SELECT item, value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME item VALUE value)""",
)
def classification_audit(spark, d):
    places, evidence = _evidence(spark, d)
    status = classify.domain_status(places, evidence)
    unmatched = classify.token_audit(places.select(F.explode("tokens").alias("token")), _dictionary(spark))
    return classify.audit(places, evidence, status, unmatched)
