"""Domains of questions, and the facets that a comparison or an evolution in a domain may have. Which words make a facet is a user's table, as functions.text.facets takes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import fold_key, once

# Folded markers of domains, the first domain with a marker in the question counts; and the facets of a domain in their order.
DOMAIN_MARKERS = {
    "source_interpretation": ["hai tu lieu", "hai tai lieu", "hai nguon", "quan diem", "cach danh gia", "cach giai thich"],
    "diplomatic_agreement": ["hiep dinh", "hoi nghi", "dam phan", "tuyen ngon"],
    "economic_policy": ["khai thac thuoc dia", "kinh te thuoc dia", "chinh sach kinh te", "cuoc khai thac"],
    "military_strategy": ["chien luoc", "chien tranh dac biet", "chien tranh cuc bo", "chien tranh don phuong", "viet nam hoa chien tranh"],
    "military_campaign": ["chien dich", "tran danh", "tran chien"],
    "movement_revolution": ["phong trao", "khoi nghia", "cach mang", "dong khoi", "tong tien cong"],
    "political_administration": ["bo may nha nuoc", "bo may cai tri", "cai cach hanh chinh", "chinh sach cai tri"],
    "state_dynasty": ["trieu dai", "nha nuoc van lang", "au lac", "nha le", "nha mac", "nha nguyen"],
    "historical_person": ["vai tro cua", "chu truong cuu nuoc", "hai nhan vat"],
}
OTHER_DOMAIN = "historical_event"
COMPARED = {
    "economic_policy": ["comparison_context", "organizer", "objectives_consequences", "scale_investment", "agriculture", "industry", "commerce", "transport", "social_transformation"],
    "military_strategy": ["comparison_context", "objectives_consequences", "forces", "geographic_scope", "strategy_methods", "scale_intensity", "representative_events", "result"],
    "military_campaign": ["comparison_context", "objectives_consequences", "leadership", "forces", "geographic_scope", "resources_logistics", "progress", "representative_events", "result", "significance"],
    "diplomatic_agreement": ["comparison_context", "participants", "objectives_consequences", "agreement_content", "implementation_mechanism", "result", "significance", "limitations"],
    "historical_person": ["comparison_context", "ideology_goals", "strategy_methods", "role_contribution", "representative_events", "result", "limitations", "significance"],
    "movement_revolution": ["comparison_context", "cause", "objectives_consequences", "leadership", "forces", "geographic_scope", "strategy_methods", "progress", "result", "significance", "limitations"],
    "political_administration": ["comparison_context", "organizer", "objectives_consequences", "organization_structure", "geographic_scope", "strategy_methods", "result", "social_transformation", "limitations"],
    "state_dynasty": ["comparison_context", "organization_structure", "geographic_scope", "forces", "economic_taxation", "culture_education", "social_transformation", "result", "limitations", "significance"],
    "source_interpretation": ["comparison_context", "source_perspective", "cause", "result", "significance", "limitations"],
    "historical_event": ["comparison_context", "cause", "objectives_consequences", "forces", "leadership", "progress", "result", "significance"],
}
EVOLVING_CORE = ["historical_evolution", "continuity_change", "cause", "result", "significance"]
EVOLVING = {
    "political_administration": ["political_administrative", "organization_structure", "governance_methods", "economic_taxation", "wartime_mobilization", "social_transformation"],
    "economic_policy": ["economic_taxation", "scale_investment", "agriculture", "industry", "commerce", "transport", "social_transformation"],
    "military_strategy": ["forces", "geographic_scope", "strategy_methods", "scale_intensity", "representative_events", "result"],
    "military_campaign": ["leadership", "forces", "geographic_scope", "resources_logistics", "progress", "representative_events", "result"],
    "movement_revolution": ["objectives_consequences", "leadership", "forces", "geographic_scope", "strategy_methods", "progress", "result"],
    "state_dynasty": ["organization_structure", "geographic_scope", "forces", "economic_taxation", "culture_education", "social_transformation", "result"],
    "multi_domain": ["political_administrative", "organization_structure", "strategy_methods", "geographic_scope", "economic_taxation", "social_transformation", "result", "significance"],
    "historical_event": ["cause", "leadership", "forces", "progress", "result", "significance"],
}
# End of fixed values.


def _list(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _of_domain(domain: Column, table: dict[str, list[str]]) -> Column:
    lists = F.create_map(*[x for name, facets in table.items() for x in (F.lit(name), _list(facets))])
    return F.coalesce(lists[domain], _list(table[OTHER_DOMAIN]))


def question_domain(text: Column, markers: dict[str, list[str]] | None = None) -> Column:
    """The first domain one of whose markers is part of the folded question."""
    table = DOMAIN_MARKERS if markers is None else markers
    hits = lambda key: F.array_compact(F.array(*[F.when(F.exists(_list(words), lambda w: F.contains(key, w)), F.lit(name)) for name, words in table.items()]))
    return F.coalesce(F.get(once(fold_key(text), hits), F.lit(0)), F.lit(OTHER_DOMAIN))


def comparison_facets(domain: Column) -> Column:
    return _of_domain(domain, COMPARED)


def evolution_facets(domain: Column) -> Column:
    """The facets of any evolution, then the domain's own."""
    return F.array_distinct(F.concat(_list(EVOLVING_CORE), _of_domain(domain, EVOLVING)))
