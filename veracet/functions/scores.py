"""Scores, ladders and labels as columns.  Ratios are 0 to 1 unless a name says percent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def rounded(x: Column, places: int) -> Column:
    """Half away from zero on the decimal value: what binary fractions add beyond ten places doesn't count."""
    return F.round(x.cast("decimal(28,10)"), places).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ladder(x: Column, steps: list[tuple[float, float | str]], last: float | str, up: bool = True) -> Column:
    """The first step whose bound x reaches (up: x >= bound, else x <= bound), else last."""
    out = None
    for at, value in steps:
        test = x >= at if up else x <= at
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(last)


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0 or missing."""
    return F.when(d > 0, n / d).otherwise(0.0)


def percent(n: Column, d: Column, places: int = 2) -> Column:
    return F.when(d > 0, rounded(n / d * 100, places)).otherwise(0.0)


def to_percent(x: Column) -> Column:
    """Ratios become percents, percents stay."""
    return F.when(x <= 1, x * 100).otherwise(x)


def age_days(then: Column, now: Column) -> Column:
    return (now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 86400


def recency_factor(observed: Column, reference: Column) -> Column:
    age = age_days(observed, reference)
    return F.when(observed.isNull() | reference.isNull(), 0.85).when(age <= 0, 1.0).otherwise(ladder(age, [(1, 1.0), (7, 0.96), (30, 0.88), (90, 0.76)], 0.65, up=False))


def staleness(last: Column, now: Column) -> Column:
    return F.when(last.isNull(), 1.0).otherwise(ladder(age_days(last, now), [(30, 1.0), (14, 0.85), (7, 0.70), (1, 0.45)], 0.20))


def freshness(last: Column, now: Column) -> Column:
    return ladder(F.floor(age_days(last, now)), [(7, "fresh"), (30, "aging")], "stale", up=False)


def completeness_label(x: Column) -> Column:
    return ladder(x, [(0.85, "complete"), (0.50, "partial")], "sparse")


def health(trust: Column, success: Column, extractable: Column, no_product: Column, strict: bool = False) -> Column:
    """Healthy, Watch or Attention from percents; strict: the bounds of the per-source page, else of the statistics."""
    (t1, s1), (t2, s2) = ((85, 85), (60, 70)) if strict else ((80, 90), (60, 75))
    good = (trust >= t1) & (success >= s1) & (extractable >= 60) & (no_product <= 35)
    fair = (trust >= t2) & (success >= s2) & (extractable >= 35) & (no_product <= 65)
    return F.when(good, "Healthy").when(fair, "Watch").otherwise("Attention")


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1))


def throttle(per_minute: Column, least: Column, most: Column) -> Column:
    """Milliseconds between requests."""
    return F.least(most, F.greatest(least, F.floor(60000 / per_minute)))


def candidate_confidence(confidence: Column, source: Column, brand: Column) -> Column:
    """A claim's confidence, raised if its source is the brand itself or a manufacturer."""
    s, b = F.lower(source), F.lower(F.trim(brand))
    bonus = F.when((b != "") & F.contains(s, b), 0.12).when(s.contains("manufacturer"), 0.10).otherwise(0.0)
    return clamp(rounded(confidence + bonus, 4), 0.05, 0.99)


def merged_confidence(base: Column, evidence: Column, agrees: Column) -> Column:
    value = base + F.when(agrees, 0.05).otherwise(-0.20) + F.least(F.lit(0.14), F.greatest(evidence - 1, F.lit(0)) * 0.07)
    return clamp(rounded(value, 4), 0.05, 0.99)


def source_quality(confidence: Column, completeness: Column) -> Column:
    return clamp(rounded(0.70 * F.coalesce(confidence, F.lit(0.70)) + 0.30 * completeness, 4), 0.05, 1.0)


_AGREES = {"low": 0.97, "medium": 0.95, "high": 0.92, "critical": 0.90}
_CONFLICTS = {"low": 0.65, "medium": 0.55, "high": 0.45, "critical": 0.35}


def by_sensitivity(sensitivity: Column, conflict: Column) -> Column:
    s = F.lower(sensitivity)
    agree, clash = F.when(s == "low", _AGREES["low"]), F.when(s == "low", _CONFLICTS["low"])
    for k in ("high", "critical"):
        agree, clash = agree.when(s == k, _AGREES[k]), clash.when(s == k, _CONFLICTS[k])
    return F.when(conflict, clash.otherwise(_CONFLICTS["medium"])).otherwise(agree.otherwise(_AGREES["medium"]))


def attribute_reliability(confidence: Column, evidence_confidence: Column, evidence: Column, sensitivity: Column, conflict: Column) -> Column:
    """By evidence so far; with none (evidence_confidence null) the claim's confidence."""
    value = 0.55 * evidence_confidence + 0.25 * confidence + 0.15 * by_sensitivity(sensitivity, conflict) + 0.05 * F.when(evidence >= 2, 1.0).otherwise(0.9)
    return clamp(rounded(F.coalesce(value, confidence), 4), 0.05, 1.0)


def merge_weight(trust: Column, quality: Column, reliability: Column, stability: Column, disagreement: Column, recency: Column) -> Column:
    return clamp(rounded(F.coalesce(trust, F.lit(0.72)) * quality * reliability * F.coalesce(stability, F.lit(0.90)) * F.coalesce(disagreement, F.lit(1.0)) * recency, 4), 0.05, 1.0)


def existing_weight(stored: Column, trust: Column, quality: Column, reliability: Column, stability: Column, confidence: Column, recency: Column) -> Column:
    """The weight of a value that a product has: what is stored, else the product of its parts, where a part that is not
    positive counts as its default (the confidence for quality and reliability)."""

    def part(value: Column, usual: Column) -> Column:
        return F.when(value > 0, value).otherwise(usual)

    made = part(trust, F.lit(0.72)) * part(quality, confidence) * part(reliability, confidence) * part(stability, F.lit(0.90)) * recency
    return clamp(F.when(stored > 0, stored).otherwise(rounded(made, 4)), 0.05, 1.0)


def completeness(values: Column, keys: Column, brand: Column, model_number: Column, gtin: Column) -> Column:
    """Share of a category's keys (completeness and identity ones together, an array) that a product has; values: its
    attributes (map), where brand, model_number and gtin are columns of its own.  A category without keys counts
    values and the three columns against eight."""
    own = {"brand": brand, "model_number": model_number, "gtin": gtin}
    said = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    keys = F.array_distinct(F.transform(F.coalesce(keys, F.array().cast("array<string>")), F.lower))

    def has(k: Column) -> Column:
        out = None
        for name, column in own.items():
            out = F.when(k == name, said(column)) if out is None else out.when(k == name, said(column))
        return out.otherwise(said(F.element_at(values, k)))

    held = F.size(F.filter(F.map_values(values), lambda v: v.isNotNull())) + sum(said(c).cast("int") for c in own.values())
    return F.when(F.size(keys) > 0, F.size(F.filter(keys, has)) / F.nullif(F.size(keys), F.lit(0))).otherwise(F.least(F.lit(1.0), held / 8.0))


def suggestion_confidence(score: Column, first_seen: Column, last_seen: Column, occurrences: Column) -> Column:
    """Of the best attribute for an unmapped name: its score, raised for names that persist (a month) and recur (20 times);
    null where the score is below 0.60."""
    days = F.greatest(F.lit(1.0), (F.unix_micros(last_seen) - F.unix_micros(first_seen)) / 86_400_000_000 + 1)
    value = score + F.least(F.lit(0.15), days / 30 * 0.15) + F.least(F.lit(0.10), occurrences / 20 * 0.10)
    return F.when(score >= 0.60, F.least(F.lit(0.99), rounded(value, 2)))


def trust(coverage: Column, conflict: Column, agreement: Column, breadth: Column, promotion: Column, success: Column, extractable: Column, no_product: Column, yielded: Column,
          price_volatility: Column, spec_stability: Column, penalty: Column) -> Column:
    value = (
        0.20 * coverage + 0.15 * (1 - conflict) + 0.20 * agreement + 0.10 * breadth + 0.05 * promotion + 0.15 * success + 0.15 * extractable + 0.05 * (1 - no_product)
        + 0.05 * yielded + 0.05 * (1 - price_volatility) + 0.05 * spec_stability - penalty
    )
    return clamp(rounded(value, 4), 0.0, 1.0)


def breadth(listings: Column, products: Column) -> Column:
    return clamp(rounded(0.40 * F.least(F.lit(1.0), listings / 10) + 0.60 * F.least(F.lit(1.0), products / 20), 4), 0.0, 1.0)


def price_volatility(changes: Column, values: Column) -> Column:
    return F.when(changes == 0, 0.0).otherwise(rounded(F.least(F.lit(1.0), changes / 12 * 0.7 + values / 6 * 0.3), 4))


def spec_stability(changes: Column) -> Column:
    return rounded(1 - F.least(F.lit(1.0), F.least(changes, F.lit(40)) / 20), 4)


def disagreement_penalty(disagreement: Column, wins: Column) -> Column:
    return clamp(rounded(0.12 * disagreement - 0.04 * wins, 4), 0.0, 1.0)


def stability(changes: Column, oscillations: Column, values: Column, suspicious: Column) -> Column:
    value = F.greatest(F.lit(0.05), rounded(1 - F.least(F.lit(1.0), changes / 20 * 0.55 + oscillations / 6 * 0.30 + values / 8 * 0.15), 4))
    return F.when(suspicious, F.least(F.lit(0.40), value)).otherwise(value)


def disagreement_adjustment(disagreement: Column, wins: Column) -> Column:
    return clamp(rounded(1 - 0.5 * disagreement + 0.25 * wins, 4), 0.45, 1.20)


def adaptive_staleness(stale: Column, stable: Column, missing: Column) -> Column:
    return clamp(rounded(stale * F.when((stable >= 0.90) & (missing == 0), 0.55).otherwise(1.0), 4), 0.0, 1.0)


def crawl_priority(quality: Column, change: Column, missing: Column, stale: Column) -> Column:
    return rounded(quality * 30 + change * 30 + missing * 25 + stale * 15, 2)


def priority_reasons(quality: Column, change: Column, missing: Column, stale: Column) -> Column:
    said = [(quality >= 0.70, "trusted source"), (change >= 0.50, "changes often"), (missing > 0, "attributes missing"), (stale >= 0.70, "stale")]
    return F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in said]), lambda x: x.isNotNull())


def crawl_intervals(page: Column, change: Column, price: Column, spec: Column) -> tuple[Column, Column]:
    """Least and most minutes between two visits."""
    least = F.when((price >= 0.65) | (change >= 0.70), 60).when(spec >= 0.90, 1440).otherwise(360)
    most = F.when((spec >= 0.92) & (change <= 0.20), 43200).when(page >= 0.60, 720).otherwise(10080)
    return least, F.greatest(least, most)


def next_interval(importance: Column, failures: Column, trust_score: Column, page: Column, change: Column, price: Column, spec: Column, failure_rate: Column) -> Column:
    """Minutes until the next visit."""
    least, most = crawl_intervals(page, change, price, spec)
    volatile = clamp((page + change + price) / 3, 0.0, 1.0)
    factor = ladder(F.coalesce(trust_score, F.lit(0.60)), [(0.85, 0.75), (0.70, 0.90), (0.50, 1.10)], 1.40) * ladder(volatile, [(0.80, 0.25), (0.60, 0.45), (0.40, 0.75)], 1.30)
    factor = factor * F.pow(rounded(1.8 + failure_rate * 1.2, 2), F.greatest(failures, F.lit(0))) * (1.15 - clamp(importance, 0.0, 1.0) * 0.55)
    return F.least(F.greatest(rounded((least + most) / 2, 0) * factor, least.cast("double")), most.cast("double"))


def page_volatility(change: Column, price: Column, spec: Column) -> Column:
    return clamp(rounded(0.40 * change + 0.35 * price + 0.25 * (1 - spec), 4), 0.0, 1.0)


def duplicate_risk(duplicates: Column) -> Column:
    return F.when(duplicates == 0, 0.0).otherwise(F.least(F.lit(100.0), 60.0 + (duplicates - 1) * 20))


def heuristic_score(crawlable: Column, relevant: Column, extractable: Column, catalog: Column, risk: Column, compatible: Column, reachable: Column, market: Column, allowed: Column) -> Column:
    score = crawlable * 0.30 + relevant * 0.25 + extractable * 0.35 + catalog * 0.10 - risk * 0.35 + F.when(compatible, 10).when(reachable, -25).otherwise(0) + market
    return clamp(rounded(F.when(allowed, score).otherwise(F.least(score, F.lit(10.0))), 2), 0.0, 100.0)


def blended_confidence(heuristic: Column, judged: Column, disagrees: Column) -> Column:
    """judged: the classifier's score, null without one."""
    score = F.when(judged.isNull(), heuristic).otherwise(heuristic * 0.6 + judged * 0.4)
    return clamp(rounded(F.when(disagrees, F.least(score, F.lit(69.99))).otherwise(score), 2), 0.0, 100.0)


def market_alignment(market_matches: Column, locale_matches: Column) -> Column:
    """Null: not asked for."""
    return F.when(market_matches, 8).when(~market_matches, -12).otherwise(0) + F.when(locale_matches, 4).when(~locale_matches, -6).otherwise(0)


def recommendation(crawlable: Column, relevant: Column, extractable: Column, catalog: Column, risk: Column, compatible: Column, reachable: Column, evidence: Column, allowed: Column,
                   heuristic: Column, accepted: Column, rejected: Column) -> Column:
    """recommended, manual_review or do_not_accept; accepted and rejected: what the page classifier said (both false: nothing)."""
    strong = (crawlable >= 55) & (relevant >= 35) & (extractable >= 55) & (catalog >= 45) & (risk < 50)
    yes, maybe, no = "recommended", "manual_review", "do_not_accept"
    differs = (accepted & (heuristic < 45)) | (rejected & (heuristic >= 70))
    return (
        F.when(~allowed, no)
        .when(compatible, F.when(strong, yes).otherwise(maybe))
        .when(accepted & (heuristic >= 70), F.when(risk < 50, yes).otherwise(maybe))
        .when(rejected & (heuristic < 45), no)
        .when(differs, maybe)
        .when(rejected, no)
        .when(reachable, F.when(evidence, maybe).otherwise(no))
        .when((catalog < 25) & (relevant < 25), no)
        .when(strong, yes)
        .otherwise(maybe)
    )


def source_value(quality: Column, trusted: Column, coverage: Column, extractable: Column, support: Column) -> Column:
    """All percents."""
    return clamp(rounded(0.40 * quality + 0.20 * trusted + 0.15 * coverage + 0.15 * extractable + 0.10 * support, 1), 0.0, 100.0)


def source_risk(trusted: Column, change: Column, disagreement: Column, coverage: Column, extractable: Column, no_product: Column) -> Column:
    return clamp(rounded((100 - trusted) * 0.25 + change * 0.20 + disagreement * 0.20 + (100 - coverage) * 0.10 + (100 - extractable) * 0.15 + no_product * 0.10, 1), 0.0, 100.0)


def readiness(assigned: Column, enabled: Column, healthy: Column) -> Column:
    return F.when(assigned == 0, "Unassigned").when(~enabled, "Blocked").when(healthy, "Ready").otherwise("Limited")


def drift_badge(events: Column) -> Column:
    return ladder(events, [(5, "Drifting"), (2, "Watch")], "Stable")


def signal_score(categories: Column, brands: Column, reasons: Column, manufacturer: Column) -> Column:
    return 10 * categories + 8 * brands + 3 * reasons + F.when(manufacturer, 5).otherwise(0)


# The states in which a run or a candidate may do what the name says.
RUN_STATES = {
    "pause": ("queued", "running"),
    "resume": ("paused",),
    "stop_at_once": ("queued", "paused"),
    "request_stop": ("running",),
    "terminal": ("cancelled", "completed", "failed"),
    "active": ("queued", "running", "paused", "cancel_requested", "recoverable"),
}
CANDIDATE_STATES = {
    "accept": ("suggested",),
    "dismiss": ("suggested", "failed", "archived"),
    "restore": ("dismissed", "archived"),
    "progress": ("pending", "probing", "awaiting_llm"),
    "supersede": ("pending", "probing", "awaiting_llm", "suggested", "auto_accepted"),
}
#: Where an action takes a run from a state that allows it.
RUN_ACTIONS = {"pause": "paused", "resume": "queued", "stop_at_once": "cancelled", "request_stop": "cancel_requested"}


def may(state: Column, action: str, states: dict[str, tuple[str, ...]] = RUN_STATES) -> Column:
    """Whether a run (or with CANDIDATE_STATES a candidate) in this state, of any case, may do it; a null state may nothing."""
    return F.coalesce(F.lower(state).isin(*states[action]), F.lit(False))


def run_after(state: Column, action: Column) -> Column:
    """The state that an operator's action leads to: a stop ends a run that waits at once, and asks one that works to end;
    actions that the state doesn't allow, and unknown ones, change nothing."""
    out = F.lower(state)
    stop = F.when(may(state, "stop_at_once"), RUN_ACTIONS["stop_at_once"]).when(may(state, "request_stop"), RUN_ACTIONS["request_stop"]).otherwise(out)
    return (
        F.when(action == "stop", stop).when((action == "pause") & may(state, "pause"), RUN_ACTIONS["pause"])
        .when((action == "resume") & may(state, "resume"), RUN_ACTIONS["resume"]).otherwise(out)
    )


def crawlability(home: Column, robots: Column, sitemap: Column, category_page: Column, product_page: Column) -> Column:
    """Of 100, by what a probe has reached (booleans)."""
    parts = ((home, 30.0), (robots, 20.0), (sitemap, 20.0), (category_page, 15.0), (product_page, 15.0))
    return sum((F.when(has, points).otherwise(0.0) for has, points in parts), F.lit(0.0))


def category_relevance(named: Column, hints: Column) -> Column:
    """Of 100: named is how many of the asked categories the pages name, hints how many links hint at them."""
    return F.least(F.lit(100.0), named * 15.0 + F.least(F.lit(55.0), hints * 12.0))


def extractability(sampled: Column, extracted: Column, structured: Column, technical: Column, accepted: Column) -> Column:
    """Of 100, by the evidence of a sample product page; accepted: a model's verdict on it (null: none), which takes 35 if it
    rejects the page, and adds 10 if it accepts one with evidence of either kind."""
    parts = ((sampled, 10.0), (extracted, 55.0), (structured, 20.0), (technical, 15.0))
    score = sum((F.when(has, points).otherwise(0.0) for has, points in parts), F.lit(0.0))
    evidence = F.coalesce(structured, F.lit(False)) | F.coalesce(technical, F.lit(False))
    return F.when(~accepted, F.greatest(F.lit(0.0), score - 35)).when(accepted & evidence, F.least(F.lit(100.0), score + 10)).otherwise(score)


def catalog_likelihood(catalog_links: Column, other_links: Column, product_page: Column) -> Column:
    """0 to 100 around 50, by links to lists of products and to other things; a product page counts as three of the first."""
    return clamp(50.0 + 6.0 * (catalog_links + F.when(product_page, 3).otherwise(0)) - 7.0 * other_links, 0.0, 100.0)
