"""Relation names brought to a fixed ontology: canonical names, then exact aliases, then ordered rules on parts of the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import fold_type

# The ontology's names, its aliases and its rules, equal to the reference's so that the same edges get the same types.
STRUCTURAL = ["HAS_STAGE", "HAS_EVENT", "HAS_PAGE", "HAS_CHUNK", "MENTIONS", "SUPPORTED_BY"]
SEMANTIC = [
    "PART_OF", "PRECEDES", "SUCCEEDS", "OCCURRED_AT", "OCCURRED_DURING", "PARTICIPATED_IN", "LED", "COMMANDED", "MEMBER_OF", "HELD_POSITION",
    "FOUNDED", "ALLY_OF", "OPPOSED", "DEFEATED", "AFFECTED", "CAUSED", "RESULTED_IN", "SIGNED", "SUPPORTED", "RELATED_TO",
]
CANONICAL = STRUCTURAL + SEMANTIC
ALIASES = {
    "THUOC": "PART_OF",
    "LA_MOT_PHAN_CUA": "PART_OF",
    "TRUC_THUOC": "PART_OF",
    "DIEN_RA_TAI": "OCCURRED_AT",
    "XAY_RA_TAI": "OCCURRED_AT",
    "DIEN_RA_TRONG": "OCCURRED_DURING",
    "THAM_GIA": "PARTICIPATED_IN",
    "THAM_CHIEN": "PARTICIPATED_IN",
    "LANH_DAO": "LED",
    "CHI_HUY": "COMMANDED",
    "THANH_VIEN_CUA": "MEMBER_OF",
    "GIU_CHUC_VU": "HELD_POSITION",
    "THANH_LAP": "FOUNDED",
    "SANG_LAP": "FOUNDED",
    "DONG_MINH": "ALLY_OF",
    "DOI_DAU": "OPPOSED",
    "CHONG_LAI": "OPPOSED",
    "DANH_BAI": "DEFEATED",
    "ANH_HUONG_TOI": "AFFECTED",
    "ANH_HUONG_DEN": "AFFECTED",
    "GAY_RA": "CAUSED",
    "DAN_DEN": "RESULTED_IN",
    "KET_QUA_LA": "RESULTED_IN",
    "KY_KET": "SIGNED",
    "KY_HIEP_DINH": "SIGNED",
    "UNG_HO": "SUPPORTED",
    "HO_TRO": "SUPPORTED",
}
#: All parts must occur in the folded name; the first rule that fits counts.
RULES = [
    (["HAS", "STAGE"], "HAS_STAGE"),
    (["HAS", "EVENT"], "HAS_EVENT"),
    (["HAS", "PAGE"], "HAS_PAGE"),
    (["HAS", "CHUNK"], "HAS_CHUNK"),
    (["MENTION"], "MENTIONS"),
    (["SUPPORTED", "BY"], "SUPPORTED_BY"),
    (["TRUOC"], "PRECEDES"),
    (["PRECEDE"], "PRECEDES"),
    (["SAU"], "SUCCEEDS"),
    (["SUCCEED"], "SUCCEEDS"),
    (["DIA_DIEM"], "OCCURRED_AT"),
    (["DIEN_RA_TAI"], "OCCURRED_AT"),
    (["XAY_RA_TAI"], "OCCURRED_AT"),
    (["DIEN_RA_TRONG"], "OCCURRED_DURING"),
    (["GIAI_DOAN"], "OCCURRED_DURING"),
    (["THAM_GIA"], "PARTICIPATED_IN"),
    (["THAM_CHIEN"], "PARTICIPATED_IN"),
    (["LANH_DAO"], "LED"),
    (["DAN_DAT"], "LED"),
    (["CHI_HUY"], "COMMANDED"),
    (["TU_LENH"], "COMMANDED"),
    (["THANH_VIEN"], "MEMBER_OF"),
    (["GIU_CHUC"], "HELD_POSITION"),
    (["DAM_NHIEM"], "HELD_POSITION"),
    (["THANH_LAP"], "FOUNDED"),
    (["SANG_LAP"], "FOUNDED"),
    (["DONG_MINH"], "ALLY_OF"),
    (["PHOI_HOP"], "ALLY_OF"),
    (["CHONG"], "OPPOSED"),
    (["DOI_DAU"], "OPPOSED"),
    (["XAM_LUOC"], "OPPOSED"),
    (["DANH_BAI"], "DEFEATED"),
    (["TIEU_DIET"], "DEFEATED"),
    (["CHIEN_THANG"], "DEFEATED"),
    (["ANH_HUONG"], "AFFECTED"),
    (["TAC_DONG"], "AFFECTED"),
    (["GAY_RA"], "CAUSED"),
    (["NGUYEN_NHAN"], "CAUSED"),
    (["DAN_DEN"], "RESULTED_IN"),
    (["KET_QUA"], "RESULTED_IN"),
    (["HE_QUA"], "RESULTED_IN"),
    (["KY", "HIEP_DINH"], "SIGNED"),
    (["KY_KET"], "SIGNED"),
    (["UNG_HO"], "SUPPORTED"),
    (["HO_TRO"], "SUPPORTED"),
    (["VIEN_TRO"], "SUPPORTED"),
    (["THUOC"], "PART_OF"),
    (["MOT_PHAN"], "PART_OF"),
]
# End of fixed values.


def canonical_relation(raw: Column) -> Column:
    name = fold_type(raw)
    out = F.lit("RELATED_TO")
    for parts, canonical in reversed(RULES):
        hit = F.lit(True)
        for p in parts:
            hit = hit & F.contains(name, F.lit(p))
        out = F.when(hit, F.lit(canonical)).otherwise(out)
    exact = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(name.isin(CANONICAL), name).otherwise(F.coalesce(exact[name], out))


def canonical_relation_sql(raw: str) -> str:
    """The same as DuckDB SQL over a folded name."""
    cases = " ".join("WHEN " + " AND ".join(f"contains({raw}, '{p}')" for p in parts) + f" THEN '{c}'" for parts, c in RULES)
    exact = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items())
    listed = ", ".join(f"'{c}'" for c in CANONICAL)
    return f"CASE WHEN {raw} IN ({listed}) THEN {raw} ELSE coalesce(CASE {raw} {exact} END, CASE {cases} ELSE 'RELATED_TO' END) END"
