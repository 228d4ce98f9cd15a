"""Evidence for activity domains: present, absent or unresolved by place, phase and domain.

Tokens and tagged texts become evidence rows; each is set against the phases seen at
the place.  One phase in common is presence, none is incompatible, several leave the
time open.  All evidence of a place is gathered in two short sets of (domain, phase)
pairs, and the states of all its phases and domains are expressions on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import bracket_balance, tagged_segments
from strandline.operators.sequence import PHASES

# The domains, the general one first; what in a phase tag names which phase; what in a body names which domain.
DOMAINS = ("general_activity", "monument", "institutional", "production")
PHASE_TAGS = (("Pa", "旧石器"), ("Jo", "縄文|^縄$"), ("Ya", "弥生|^弥$"), ("Ko", "古墳"), ("Na", "奈良|^奈$"), ("He", "平安"), ("Me", "中世|^中$"))
FEATURES = (
    ("general_activity", "住居|竪穴住居|敷石住居|掘立柱建物|貝塚|集落|井戸|水田|畑|町屋|屋敷", "Pa;Jo;Ya;Ko;Na;He;Me"),
    ("monument", "前方後円墳|円墳|方墳|古墳|横穴墓|横穴式石室|石室|墳丘|周溝墓|方形周溝墓|経塚|(?<!貝)塚", "Ya;Ko;Me"),
    ("institutional", "官衙|郡衙|国府|政庁|寺院|寺跡|社寺|神社|伽藍|城館|城跡|居館|館跡|陣屋|関所", "Na;He;Me"),
    ("production", "窯|灰原|鍛冶|製鉄|鉄滓|工房|鋳造|鋳物|炭窯|炭焼|生産", "Ko;Na;He;Me"),
)


def _codes(s: Column, phases: tuple[str, ...]) -> Column:
    """Codes of the phases present in a states array."""
    return F.filter(F.transform(s, lambda x, i: F.when(x == 1, F.element_at(F.array(*map(F.lit, phases)), i + 1))), lambda c: c.isNotNull())


def assignment(observed: Column, allowed: Column) -> tuple[Column, Column]:
    """(status, compatible phases) of evidence with ``allowed`` phases at a place where ``observed`` were seen."""
    both = F.array_intersect(observed, allowed)
    return F.when(F.size(both) == 1, "present").when(F.size(both) == 0, "incompatible").otherwise("temporally_ambiguous"), both


def token_audit(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(token, n_records, bracket_balance)`` of the tokens that the dictionary lacks."""
    missing = tokens.join(dictionary.select("token").distinct(), "token", "left_anti")
    return missing.groupBy("token").agg(F.count("*").alias("n_records")).withColumn("bracket_balance", bracket_balance(F.col("token")))


def token_evidence(places: DataFrame, dictionary: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Evidence of ``(place_id, states, tokens)`` rows by ``(token, activity_domain, evidence_role, allowed_phases)``.

    Neutral tokens are no evidence.
    """
    rows = places.select("place_id", _codes(F.col("states"), phases).alias("observed"), F.explode("tokens").alias("token"))
    known = dictionary.where("evidence_role <> 'neutral' AND activity_domain IS NOT NULL")
    status, both = assignment(F.col("observed"), F.transform(F.split("allowed_phases", ";"), F.trim))
    return rows.join(known, "token").select("place_id", "activity_domain", F.lit("token").alias("source"), status.alias("assignment_status"), both.alias("compatible"))


def _first_phase(tag: Column, rules) -> Column:
    out = F.lit(None).cast("string")
    for code, pattern in reversed(rules):
        out = F.when(tag.rlike(pattern), code).otherwise(out)
    return out


def tagged_evidence(places: DataFrame, text: str = "features", rules=PHASE_TAGS, features=FEATURES, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Evidence of texts ``[phase]body``: the phase from the tag only, the domain from the body only."""
    rows = places.select("place_id", _codes(F.col("states"), phases).alias("observed"), F.explode(tagged_segments(F.col(text))).alias("s"))
    hits = F.array(*[F.when(F.col("s.body").rlike(p), F.struct(F.lit(d).alias("domain"), F.split(F.lit(a), ";").alias("allowed"))) for d, p, a in features])
    found = rows.withColumn("phase", _first_phase(F.col("s.tag"), rules)).where("phase IS NOT NULL").withColumn("h", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    fits = F.array_contains("h.allowed", F.col("phase")) & F.array_contains("observed", F.col("phase"))
    return found.select(
        "place_id", F.col("h.domain").alias("activity_domain"), F.lit("tagged").alias("source"), F.when(fits, "present").otherwise("incompatible").alias("assignment_status"),
        F.when(fits, F.array("phase")).otherwise(F.array().cast("array<string>")).alias("compatible"),
    )


def untagged_evidence(places: DataFrame, text: str = "features", features=FEATURES, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Evidence of texts without any tag, only where a single phase was seen."""
    rows = places.select("place_id", _codes(F.col("states"), phases).alias("observed"), F.col(text).alias("body")).where((F.size("observed") == 1) & ~F.col("body").contains("["))
    hits = F.array(*[F.when(F.col("body").rlike(p), F.struct(F.lit(d).alias("domain"), F.split(F.lit(a), ";").alias("allowed"))) for d, p, a in features])
    found = rows.withColumn("h", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    status, both = assignment(F.col("observed"), F.col("h.allowed"))
    return found.select("place_id", F.col("h.domain").alias("activity_domain"), F.lit("untagged").alias("source"), status.alias("assignment_status"), both.alias("compatible"))


def domain_status(places: DataFrame, evidence: DataFrame, phases: tuple[str, ...] = PHASES, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """``(place_id, phase_order, phase_code, activity_domain, phase_presence, domain_presence, domain_status)``.

    A special domain is present with direct evidence, unresolved where only the time
    is open, else absent.  The general domain is present if said so, or if nothing
    special is; it is unresolved where it or a special domain is open in time.
    Phases in which the place was not seen are absent in every domain.
    """
    general, special = domains[0], domains[1:]
    pair = lambda d, p: F.concat(d, F.lit("|"), p)
    spread = evidence.select("place_id", "activity_domain", "assignment_status", F.explode("compatible").alias("phase"))
    key = pair(F.col("activity_domain"), F.col("phase"))
    sets = spread.groupBy("place_id").agg(
        F.collect_set(F.when(F.col("assignment_status") == "present", key)).alias("__direct"), F.collect_set(F.when(F.col("assignment_status") == "temporally_ambiguous", key)).alias("__open")
    )
    none = F.array().cast("array<string>")
    rows = places.select("place_id", "states").join(sets, "place_id", "left").withColumns({"__direct": F.coalesce("__direct", none), "__open": F.coalesce("__open", none)})
    names = F.array(*map(F.lit, phases))
    grid = rows.select("place_id", "__direct", "__open", F.posexplode("states").alias("i", "phase_presence")).withColumn("phase_code", F.element_at(names, F.col("i") + 1))
    any_of = lambda kind: F.exists(F.array(*map(F.lit, special)), lambda d: F.array_contains(kind, pair(d, F.col("phase_code"))))
    grid = grid.withColumns({"__sp": any_of("__direct"), "__so": any_of("__open")}).withColumn("activity_domain", F.explode(F.array(*map(F.lit, domains))))
    own = pair(F.col("activity_domain"), F.col("phase_code"))
    direct, ambiguous = F.array_contains("__direct", own), F.array_contains("__open", own)
    is_general = F.col("activity_domain") == general
    status = (
        F.when(F.col("phase_presence") == 0, "apparent_absence").when(is_general & direct, "present_general_explicit")
        .when(is_general & F.col("__sp") & ambiguous, "temporally_ambiguous_general_candidate").when(is_general & F.col("__sp"), "excluded_specialized_only")
        .when(is_general & F.col("__so"), "temporally_ambiguous_due_to_specialized").when(is_general, "present_general_default")
        .when(direct, "present").when(ambiguous, "temporally_ambiguous").otherwise("no_positive_domain_evidence")
    )
    named = grid.withColumn("domain_status", status)
    presence = F.when(F.col("domain_status").startswith("present"), 1).when(F.col("domain_status").startswith("temporally_ambiguous"), F.lit(None)).otherwise(0)
    return named.select("place_id", (F.col("i") + 1).alias("phase_order"), "phase_code", "activity_domain", "phase_presence", presence.cast("int").alias("domain_presence"), "domain_status")


def wide(status: DataFrame, phases: tuple[str, ...] = PHASES, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """One row for each place, a column ``<domain>_<phase>`` for each state, and ``<domain>_any`` over the phases."""
    cell = lambda d, p: F.max(F.when((F.col("activity_domain") == d) & (F.col("phase_code") == p), F.col("domain_presence")))
    any_ = lambda d: F.when(F.max(F.when(F.col("activity_domain") == d, F.col("domain_presence"))) == 1, 1).when(F.count_if((F.col("activity_domain") == d) & F.col("domain_presence").isNull()) > 0, F.lit(None)).otherwise(0)
    return status.groupBy("place_id").agg(*[cell(d, p).alias(f"{d}_{p}") for d in domains for p in phases], *[any_(d).alias(f"{d}_any") for d in domains])


def audit(places: DataFrame, evidence: DataFrame, status: DataFrame, unmatched: DataFrame) -> DataFrame:
    """``(item, value)``: counts, of which those named ``*_when_*`` and ``duplicate_*`` must be zero."""
    by_kind = evidence.agg(*[F.count_if(F.col("assignment_status") == k).alias(n) for k, n in (("present", "direct_present_assignments"), ("incompatible", "incompatible_assignments"), ("temporally_ambiguous", "temporally_ambiguous_assignments"))])
    states = status.agg(
        F.countDistinct("place_id").alias("output_rows"), F.count_if(F.col("domain_presence").isNull()).alias("domain_unresolved_phase_statuses"),
        F.count_if(F.col("domain_status") == "temporally_ambiguous_due_to_specialized").alias("general_unresolved_due_to_specialized_ambiguity"),
        F.count_if((F.col("phase_presence") == 0) & (F.col("domain_presence") == 1)).alias("domain_presence_when_phase_absent"),
        (F.count("*") - F.countDistinct("place_id", "phase_code", "activity_domain")).alias("duplicate_row_phase_domain"),
    )
    tokens = unmatched.agg(F.count("*").alias("unclassified_token_types"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("unclassified_token_occurrences"), F.count_if(F.col("bracket_balance") != 0).alias("unbalanced_parenthesis_token_types"))
    rows = [places.agg(F.count("*").alias("input_rows")), by_kind, states, tokens]
    out = None
    for r in rows:
        part = r.unpivot([], r.columns, "item", "value")
        out = part if out is None else out.unionByName(part)
    return out
