"""Column expressions for names, keys, words, years, headings and facets. All stay inside generated code."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    source, target = [], []
    for point in range(0x80, sys.maxunicode + 1):
        sign = chr(point)
        parts = unicodedata.normalize("NFD", sign)
        if parts != sign:
            base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
            if len(base) == 1 and (base.isascii() or base in "đĐ"):
                source.append(sign)
                target.append(base)
    return "".join(source) + "đĐ", "".join(target) + "dD"


_ACCENTED, _PLAIN = _accent_table()
# Folded words that full-text queries, and scores of published records, leave out; and the signs of a query's words.
QUERY_STOP = ["ai", "bao", "biet", "cac", "cho", "co", "cua", "duoc", "gi", "hay", "khi", "la", "minh", "mot", "nam", "nay", "nhung", "noi", "o", "the", "thi", "toi", "trong", "tu", "va", "ve"]
RECORD_STOP = ["ai", "bao", "cac", "cho", "cua", "duoc", "gi", "hay", "khi", "la", "nao", "noi", "o", "ra", "tai", "the", "thoi", "vao", "va", "ve", "vay"]
QUERY_WORD = "[0-9A-Za-zÀ-ỹĐđ_-]+"
# How a section begins, what is no name of an entity, quantities, and how names of a type begin (folded, but for places).
SECTION = r"(?iu)^(?:chương|phần|mục|tiết|[IVXLC]+[.)]|[0-9]+(?:\.[0-9]+)*[.)])\s*"
NO_ENTITY = ["nhan dan", "nhan dan ta", "quan va dan ta", "chinh phu", "quan doi", "bo doi", "quan chung", "chien tranh", "cong san", "mien nam", "mien bac"]
QUANTITY = r"^\d[\d\s.,/-]*(?:nguoi|quan|binh\s+si|chien\s+si|nam|thang|ngay)?$"
LONE_YEAR = r"^(?:nam\s+)?(?:1[0-9]{3}|20[0-9]{2})$"
TYPE_PREFIXES = {
    "EVENT": ["hiep dinh ", "hiep nghi ", "hoi nghi ", "chien dich ", "tran ", "cuoc khoi nghia ", "khoi nghia ", "phong trao ", "cach mang ", "cuoc tong tien cong ", "tong tien cong "],
    "DOCUMENT": ["sac lenh ", "nghi quyet ", "chi thi ", "tuyen ngon ", "bao cao ", "hien phap ", "dao luat ", "luat "],
    "ORGANIZATION": ["dang ", "mat tran ", "quan doi ", "uy ban ", "chinh phu ", "bo tu lenh ", "bo chi huy ", "vien nghien cuu "],
}
PLACE_PREFIX = r"(?iu)^(?:tỉnh|thành\s+phố|huyện|sông|núi|đèo|đảo|quần\s+đảo|vĩ\s+tuyến|cứ\s+điểm)\s+"
PERSON_TITLE = r"(?iu)^(?:chủ\s+tịch|đại\s+tướng|thượng\s+tướng|trung\s+tướng|thiếu\s+tướng|tướng|đồng\s+chí|nữ\s+tướng|bà|ông)\s+"
# End of fixed values.
_EDGES = " \t\n\r.,;:!?()[]{}\"'"


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often a lambda looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_accents(x: Column) -> Column:
    """Base letters for accented ones; texts of ASCII alone are left as they are."""
    ascii_only = F.octet_length(x) == F.char_length(x)
    return F.when(ascii_only, x).otherwise(F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), r"\p{Mn}+", ""))


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clean_name(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(_EDGES))


def fold_key(x: Column) -> Column:
    """Search key: no accents, no case, no punctuation, one blank between words; null is empty."""
    plain = F.replace(F.lower(without_accents(F.coalesce(x, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(plain, "[^0-9a-z]+", " "))


def fold_type(x: Column) -> Column:
    """Relation name: no accents, upper case, one underscore between words."""
    plain = F.upper(without_accents(F.coalesce(x, F.lit(""))))
    return F.btrim(F.regexp_replace(plain, "[^A-Z0-9]+", "_"), F.lit("_"))


def content_hash(x: Column) -> Column:
    return F.sha2(F.lower(collapsed(F.coalesce(x, F.lit("")))), 256)


def words(x: Column, stop: list[str] | None = None) -> Column:
    """Distinct words of the search key with two letters at least that aren't in the stop list, in order of appearance."""
    telling = (lambda w: (F.length(w) >= 2) & ~w.isin(stop)) if stop else (lambda w: F.length(w) >= 2)
    return F.array_distinct(F.filter(F.split(fold_key(x), " "), telling))


def word_count(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"\S+"))


def years(x: Column) -> Column:
    """Years 1000 to 2099 that stand alone among digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?<!\d)(1\d{3}|20\d{2})(?!\d)"), 1), lambda y: y.cast("int"))


def heading(x: Column) -> Column:
    """The first line that isn't blank, where it reads like a heading of the lines below; else empty."""
    def told(found):
        first = F.get(found, F.lit(0))
        letters, upper = F.regexp_count(first, F.lit(r"\p{L}")), F.regexp_count(first, F.lit(r"\p{Lu}"))
        fits = (F.size(found) >= 2) & F.length(first).between(3, 120) & (word_count(first) <= 18) & ~first.rlike("[.,;?!]$")
        return F.when(fits & (first.rlike(SECTION) | ((letters > 0) & (upper >= 0.65 * letters))), first).otherwise("")

    return once(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), collapsed), lambda s: s != ""), told)


def canonical_id(kind: Column, name: Column) -> Column:
    key = fold_key(name)
    digest = F.substring(F.sha2(F.concat_ws(":", kind, key), 256), 1, 10)
    return F.concat_ws(":", F.lower(kind), F.substring(F.replace(key, F.lit(" "), F.lit("-")), 1, 96), digest)


def display_date(x: Column) -> Column:
    """d/m/yyyy of an ISO date; anything else as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), "d/M/yyyy"), x)


def facets(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """Names of facets, in the taxonomy's order, any of whose terms is part of the text's search key."""
    return once(fold_key(text), lambda key: F.array_compact(F.array(*[F.when(_any(key, terms), F.lit(name)) for name, terms in taxonomy.items()])))


def facet_changes(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per facet: how many rows (old array, new array) had it, have it, and differ in it: facet, old_n, new_n, changed."""
    told = rows.select("old", "new", F.explode(F.array(*[F.lit(n) for n in names])).alias("facet"))
    had, has = F.array_contains("old", F.col("facet")), F.array_contains("new", F.col("facet"))
    return told.groupBy("facet").agg(F.count_if(had).alias("old_n"), F.count_if(has).alias("new_n"), F.count_if(had != has).alias("changed"))


def _any(key: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(key, F.lit(term))
    return found


def grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a blank."""

    def runs(t):
        last = F.size(t) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " "))

    return once(tokens, runs)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of tokens; 0 where either is empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def capped_search_terms(x: Column, stop: list[str] | None = None, most: int = 14) -> Column:
    """Distinct lower-case words for a full-text query: two folded letters at least, not in the stop list once folded, the first `most`."""
    stop = QUERY_STOP if stop is None else stop
    raw = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({QUERY_WORD})"), 1)
    trimmed = F.transform(raw, lambda w: F.btrim(w, F.lit("_-")))
    kept = F.filter(trimmed, lambda w: (F.length(fold_key(w)) >= 2) & ~fold_key(w).isin(stop))
    return F.slice(F.array_distinct(kept), 1, most)


def surface_is_name(x: Column, generic: list[str] | None = None, prefixes: dict[str, list[str]] | None = None, curated: Column | None = None) -> Column:
    """Whether a surface form may name an entity: not empty, generic, a quantity, a date or a year, and curated, with a capital or telling its type."""
    name, key = clean_name(x), fold_key(x)
    telling = (F.lit(False) if curated is None else F.coalesce(curated, F.lit(False))) | name.rlike(r"\p{Lu}") | (inferred_type(x, prefixes) != "")
    return (key != "") & ~key.isin(NO_ENTITY if generic is None else generic) & ~key.rlike(QUANTITY) & ~key.rlike(LONE_YEAR) & telling


def inferred_type(x: Column, prefixes: dict[str, list[str]] | None = None) -> Column:
    """LOCATION for names that begin as places do, else the first type one of whose prefixes begins the search key; else empty."""
    key = fold_key(x)
    out = F.lit("")
    for kind, starts in reversed((TYPE_PREFIXES if prefixes is None else prefixes).items()):
        out = F.when(F.exists(F.array(*[F.lit(s) for s in starts]), lambda s: key.startswith(s)), F.lit(kind)).otherwise(out)
    return F.when(clean_name(x).rlike(PLACE_PREFIX), "LOCATION").otherwise(out)
