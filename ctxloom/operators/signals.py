"""Signals from free text for the risk engines: who it is about, what was observed, what it hints at.

An extractor is data: patterns for the signal's own id, for other ids, for figures, hints and
flags. All texts are read by column expressions; a text with ids gives one signal for each
different id, and what stands between an id and the next is its own part of the text. What the
part lacks is taken from the whole text, the i-th signal from the i-th finding or the last. A
text without an id gives one signal, named by the text's checksum.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .risk import decide


@dataclass(frozen=True)
class Extractor:
    #: the signal's own id, and the prefix of one made up
    own: str
    prefix: str
    #: other ids: (pattern, what stands for none); a pattern with a group gives that, behind the prefix
    ids: dict[str, tuple[str, str]]
    #: figures: (pattern, what one is worth), the earlier pattern first
    figures: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)
    #: words that hint at something
    hint: str | None = None
    #: of several hints in the signal's part, the last counts
    last_hint: bool = False
    flags: dict[str, str] = field(default_factory=dict)
    #: what the engine reads off hint and flags, as SQL
    marks: dict[str, str] = field(default_factory=dict)
    #: other ids go around, and figures are the largest of the text
    around: bool = False


_TAIL = r"(?:[-_][A-Za-z0-9]+|[0-9]{2,}[A-Za-z0-9]*)(?:[-_][A-Za-z0-9]+)*"
_SHORT = r"(?:[-_][A-Za-z0-9]{2,}|[0-9]{2,}[A-Za-z0-9]*)"


def _id(words: str, tail: str) -> str:
    return rf"(?i)\b(?:{words}){tail}\b"


# The patterns of ids, figures, hints and flags.
EXTRACTORS = {
    "supply_chain": Extractor(
        r"(?i)\b(?:ORD|ORDER)[-_]?[A-Za-z0-9]{3,}\b", "ORD-",
        {"lane": (r"(?i)\bLANE-[A-Za-z0-9-]{3,}\b", "LANE-AUTO-01"), "supplier": (r"(?i)\b(?:SUP|SUPPLIER)[-_]?[A-Za-z0-9]{2,}\b", "SUP-AUTO-01")},
        {"observed_delay_hours": ((r"(?i)\b(\d{1,3})\s*(?:h|hr|hrs|hour|hours)\b", 1),)}, around=True,
    ),
    "pharmacovigilance": Extractor(
        r"(?i)\b(?:AE|CASE|PV)[-_]?[A-Za-z0-9]{3,}\b", "AE-",
        {"lot": (r"(?i)\bLOT[-_]?[A-Za-z0-9]{3,}\b", "LOT-AUTO-01"), "compound": (r"(?i)\b(?:CMP|DRUG|MED)[-_]?[A-Za-z0-9]{2,}\b", "CMP-AUTO-01")},
        {"observed_cases": ((r"(?i)\b(\d{1,5})\s*(?:reports|cases|events)\b", 1),)},
        r"(?i)\b(?:anaphylaxis|arrhythmia|hepatotoxicity|renal failure|thrombosis|seizure|rash|death)\b",
    ),
    "clinical": Extractor(
        _id("UNIT|WARD|ICU|ED|FLOOR", _TAIL), "UNIT-", {"team": (_id("TEAM|SERVICE|SQUAD", _TAIL), "TEAM-AUTO-01"), "service_line": (_id("LINE|SPECIALTY|SERVICE-LINE", _TAIL), "LINE-AUTO-01")},
        {"observed_occupancy": ((r"(?i)\b(\d{1,3})\s*%\s*occupancy\b", 1),), "boarding_hours": ((r"(?i)\b(\d{1,3})\s*hours?\b", 1),), "waiting": ((r"(?i)\b(\d{1,4})\s*(?:patients?|admissions?)\b", 1),)},
        "(?i)sepsis|stroke|trauma surge|respiratory failure|icu overflow|diversion", True,
        {"acute": "(?i)(?:high acuity|critical patients|code blue|rapid response)", "diverting": "(?i)(?:diversion|boarding crisis|capacity crisis)"},
        {"hinted": "hint in ('sepsis', 'stroke', 'trauma surge', 'respiratory failure', 'diversion')"},
    ),
    "emergency": Extractor(
        _id("EOC|INC|EVENT|HAZ", _SHORT), "EOC-", {"zone": (_id("ZONE|SECTOR|DISTRICT", _SHORT), "ZONE-AUTO-01"), "crew": (_id("UNIT|TEAM|CREW", _SHORT), "UNIT-AUTO-01")},
        {
            "observed_people": ((r"(?i)\b(\d{1,8})\s*(?:people|residents|evacuees|households)\b", 1),),
            "observed_minutes": ((r"(?i)\b(\d{1,4})\s*(?:min|mins|minutes?)\b", 1), (r"(?i)\b(\d{1,3})\s*(?:h|hr|hrs|hours?)\b", 60)),
        },
        "(?i)hospital|nursing home|elderly|school|dialysis|prison|shelter|water treatment", False,
        {"mandatory": "(?i)(?:mandatory evacuation|evacuation order|immediate evacuation)"}, {"vulnerable": "hint is not null"},
    ),
    "grid_outage": Extractor(
        _id("OUT|OUTAGE|INC|EVENT", _SHORT), "OUT-", {"substation": (_id("SUB|SUBSTATION", _SHORT), "SUB-AUTO-01"), "feeder": (_id("FEEDER|FDR|LINE", _SHORT), "FEEDER-AUTO-01")},
        {
            "observed_customers": ((r"(?i)\b(\d{1,8})\s*(?:customers?|accounts?)\b", 1),),
            "observed_minutes": ((r"(?i)\b(\d{1,4})\s*(?:min|mins|minutes?)\b", 1), (r"(?i)\b(\d{1,3})\s*(?:h|hr|hrs|hours?)\b", 60)),
        },
        "(?i)hospital|water treatment|dialysis|ems|911|fire station|airport|nursing home", False,
        {"cascading": r"(?i)\bcascad(?:e|ing)\b"}, {"hospital_hint": "hint = 'hospital'", "facility_hint": "hint is not null"},
    ),
    "manufacturing": Extractor(
        _id("MFG|ANOM|FAULT|INC", _SHORT), "MFG-",
        {"line": (_id("LINE|CELL|STATION", _SHORT), "LINE-AUTO-01"), "asset": (_id("ASSET|MACHINE|ROBOT|PRESS|MILL", _SHORT), "ASSET-AUTO-01"), "shift": (r"(?i)\b(?:shift|batch)[-_ ]?([A-Za-z0-9]{1,8})\b", "SHIFT-AUTO")},
        {
            "observed_drop": ((r"(?i)\b(\d{1,3}(?:\.\d+)?)\s*%\s*(?:yield\s*)?(?:drop|decline|decrease|down)\b", 0.01),), "observed_vibration": ((r"(?i)\b(\d{1,4}(?:\.\d+)?)\s*(?:mm/s|ips|vibration)\b", 1),),
            "observed_heat": ((r"(?i)\b(\d{1,4}(?:\.\d+)?)\s*(?:c|f|deg|°c|°f)\b", 1),),
        },
        "(?i)firmware|calibration|bearing|alignment|contamination|tool wear|sensor drift|coolant", False,
        {"safety": "(?i)(?:safety interlock|near miss|operator injury|emergency stop|lockout)"}, {"firmware": "hint = 'firmware'"},
    ),
    "contract": Extractor(
        _id("CONTRACT|AGR|AGREEMENT|MSA|SOW", _TAIL), "CONTRACT-", {"clause": (_id("CLAUSE|SEC|SECTION|TERM|ARTICLE", _TAIL), "CLAUSE-AUTO-01"), "counterparty": (_id("VENDOR|PARTY|CP|SUPPLIER", _TAIL), "VENDOR-AUTO-01")},
        {"months": ((r"(?i)\b(\d{1,4})\s*months?\b", 1), (r"(?i)\b(\d{1,3})\s*years?\b", 12)), "observed_cap": ((r"(?i)\b(\d{1,3}(?:\.\d+)?)\s*x\b", 1),)},
        "(?i)unlimited liability|broad data use rights|indemnity|ip ownership|audit rights|termination for convenience|exclusivity|auto-renewal|most favored nation", False,
        {"unlimited": "(?i)(?:unlimited liability|uncapped liability|no liability cap|without liability cap)", "strategic": "(?i)(?:strategic vendor|sole source|single supplier|critical vendor|mission[- ]critical vendor)"},
        {"hinted": "hint in ('unlimited liability', 'broad data use rights', 'indemnity')"},
    ),
    "migration": Extractor(
        _id("APP|SERVICE|SYSTEM|LEGACY|WORKLOAD|PLATFORM", _TAIL), "SYSTEM-", {"service": (_id("MODULE|DOMAIN|COMPONENT|API|JOB", _TAIL), "SERVICE-AUTO-01"), "owner": (_id("TEAM|OWNER|SQUAD|GROUP", _TAIL), "TEAM-AUTO-01")},
        {
            "age_years": ((r"(?i)\b(\d{1,2})\s*years?\b", 1),), "outage_hours": ((r"(?i)\b(\d{1,4})\s*hours?\b", 1),),
            "observed_dependencies": ((r"(?i)\b(\d{1,4})\s*(?:dependencies|integrations|services|connectors?)\b", 1),),
        },
        "(?i)mainframe|eol runtime|unsupported os|manual release|shared database|hard-coded secret|single point of failure|vendor lock-in", False,
        {"unsupported": "(?i)(?:eol|end of support|unsupported|out[- ]of[- ]support)", "critical": "(?i)(?:mission[- ]critical|revenue[- ]critical|customer[- ]critical|safety[- ]critical)"},
        {"hinted": "hint in ('mainframe', 'eol runtime', 'shared database', 'single point of failure')"},
    ),
    "regulatory": Extractor(
        _id("REG|RULE|LAW|ACT|REQ", _TAIL), "REG-", {"domain": (_id("DOMAIN|CONTROL|POLICY|AREA", _TAIL), "DOMAIN-AUTO-01"), "owner": (_id("TEAM|OWNER|SQUAD", _TAIL), "TEAM-AUTO-01")},
        {"observed_deadline": ((r"(?i)\b(\d{1,4})\s*days?\b", 1),), "observed_obligations": ((r"(?i)\b(\d{1,3})\s*(?:obligations?|requirements?|controls?)\b", 1),)},
        "(?i)model inventory|risk tier|attestation|audit|incident reporting|data retention|human oversight|monitoring|transparency", False,
        {"enforcement": "(?i)(?:mandatory|required|must comply|enforcement|fine|penalty|non-compliance)"},
    ),
}
#: A lane may also be a pair of ports.
PORTS = r"\b[A-Z]{3}\s*(?:->|TO)\s*[A-Z]{3}\b"


def _name(found: Column) -> Column:
    return F.upper(F.replace(F.trim(found), F.lit("_"), F.lit("-")))


#: The spellings of s and k beyond ASCII.
LONG_S, KELVIN = "\u017f", "\u212a"


def _java(pattern: str) -> str:
    """The pattern for Java's regular expressions, as it is meant: words and blanks are those of ASCII, letter case folds as RE2 folds it.

    `\b` stands only before a first and behind a last word character. Java would hold letters
    beyond ASCII for parts of a word, a vertical tab for a blank, and the long s and the Kelvin
    sign for no spelling of s and k. What a match begins with is asked first, as most places fail there.
    """
    body, folds = pattern.removeprefix("(?i)"), pattern.startswith("(?i)")
    body = re.sub(r"^\\b", "(?<![A-Za-z0-9_])", body)
    body = re.sub(r"\\b$", "(?![A-Za-z0-9_])", body).replace(r"\s", r"[\t\n\f\r ]")
    if not folds:
        return body
    words = pattern.removeprefix("(?i)").removeprefix(r"\b").removeprefix("(?:").split(")")[0].split("|")
    first = r"\d" if words[0].startswith(r"(\d") else "".join(sorted({w[0].lower() for w in words}))
    first += LONG_S * ("s" in first) + KELVIN * ("k" in first)
    body = re.sub(r"(?<!\\)[sS]", f"[s{LONG_S}]", re.sub(r"(?<!\\)[kK]", f"[k{KELVIN}]", body))
    body = re.sub(r"(?<!<!)(?<!\?!)\[A-Za-z0-9", f"[A-Za-z{LONG_S}{KELVIN}0-9", body)
    return f"(?i)(?=[{first}])(?:{body})"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(group))


def _worth(one: float):
    """A function from a found figure to what it is worth."""
    return lambda x: x.cast("double") / round(1 / one) if one < 1 else x.cast("double") * float(one)


def _nth(values: Column, i: Column) -> Column:
    """The i-th from 0, or the last; null if there is none."""
    return F.get(values, F.least(i, F.size(values) - 1))


def extract(docs: DataFrame, engine: str, most: int = 20) -> DataFrame:
    """docs(*, text) with `signal` and `signal_id`, the other ids, the figures, `hint`, flags and marks of each signal.

    At most `most` signals a text, the first ones. A null text is as an empty one. Figures of 0
    count as none.
    """
    e = EXTRACTORS[engine]
    text = F.coalesce("text", F.lit(""))
    grouped = {name: int("([A-Za-z0-9]{1,8})" in pattern) for name, (pattern, _) in e.ids.items()}
    # each pattern reads the whole text once, in the text's own row; what is found is cut to what `most` signals can ask for
    read = {"_runs": _all(text, e.own), "_gaps": F.split(text, _java(e.own))}
    read |= {f"_id_{name}": _all(text, pattern, grouped[name]) for name, (pattern, _) in e.ids.items()}
    read |= {f"_figure_{name}_{n}": _all(text, pattern, 1) for name, patterns in e.figures.items() for n, (pattern, _) in enumerate(patterns)}
    read |= {f"_flag_{name}": text.rlike(_java(pattern)) for name, pattern in e.flags.items()}
    if e.around and "lane" in e.ids:
        read["_pairs"] = _all(F.upper(text), PORTS)
    if e.hint:
        read["_hints"] = _all(text, e.hint)
    rows = docs.withColumns(read).withColumn("_names", F.transform("_runs", _name))

    def signal(name):
        at = F.array_position("_names", name).cast("int")
        return F.struct(name.alias("id"), F.concat(F.get("_runs", at - 1), F.get("_gaps", at)).alias("part"))

    different = F.transform(F.slice(F.array_distinct("_names"), 1, most), signal)
    alone = F.array(F.struct(F.concat(F.lit(e.prefix), F.upper(F.substring(F.sha2(text, 256), 1, 8))).alias("id"), F.lit("").alias("part")))
    known = {"_all": F.when(F.size("_names") > 0, different).otherwise(alone)}
    named_by = {name: (lambda x: F.concat(F.lit("SHIFT-"), F.upper(x))) if grouped[name] else _name for name in e.ids}
    for name in e.ids:
        found = F.transform(f"_id_{name}", named_by[name])
        if e.around:
            if name == "lane":
                pairs = F.transform("_pairs", lambda x: F.replace(F.regexp_replace(x, r"\s+", ""), F.lit("TO"), F.lit("->")))
                found = F.concat(found, pairs)
            found = F.array_distinct(found)
        known[f"_id_{name}"] = F.slice(found, 1, most)
    for name, patterns in e.figures.items():
        everywhere = F.concat(*[F.transform(f"_figure_{name}_{n}", _worth(one)) for n, (_, one) in enumerate(patterns)])
        known[f"_figure_{name}"] = F.array_max(everywhere) if e.around else F.slice(everywhere, 1, most)
    if e.hint:
        known["_hints"] = F.slice("_hints", 1, most)
    rows = rows.select(*docs.columns, *[F.col(f"_flag_{name}") for name in e.flags], *[c.alias(name) for name, c in known.items()])
    # outer, though no text is without a signal: else a filter on the signals is inferred, which reads the text again for each
    rows = rows.select("*", F.posexplode_outer("_all").alias("signal", "_s")).withColumn("signal_id", F.col("_s.id"))
    i, part = F.col("signal"), F.col("_s.part")
    near = {} if e.around else {f"_near_{name}": F.regexp_extract(part, _java(pattern), grouped[name]) for name, (pattern, _) in e.ids.items()}
    near |= {} if e.around else {f"_near_{name}_{n}": F.regexp_extract(part, _java(pattern), 1) for name, patterns in e.figures.items() for n, (pattern, _) in enumerate(patterns)}
    if e.hint:
        near["_near_hint"] = F.element_at(F.concat(F.array(F.lit("")), _all(part, e.hint)), -1) if e.last_hint else F.regexp_extract(part, _java(e.hint), 0)
    rows = rows.withColumns(near)

    def beside(name):
        return F.nullif(F.col(f"_near_{name}"), F.lit(""))

    columns: dict[str, Column] = {}
    for name, (_, none) in e.ids.items():
        found = F.col(f"_id_{name}")
        if e.around:
            columns[name] = F.coalesce(F.get(found, F.when(F.size(found) > 0, F.pmod(i, F.greatest(F.size(found), F.lit(1))))), F.lit(none))
        else:
            columns[name] = F.coalesce(named_by[name](beside(name)), _nth(found, i), F.lit(none))
    for name, patterns in e.figures.items():
        found = F.col(f"_figure_{name}")
        one = found if e.around else F.coalesce(*[_worth(w)(beside(f"{name}_{n}")) for n, (_, w) in enumerate(patterns)], _nth(found, i))
        columns[name] = F.nullif(one, F.lit(0.0))
    if e.hint:
        columns["hint"] = F.lower(F.coalesce(beside("hint"), _nth(F.col("_hints"), i)))
    for name in e.flags:
        columns[name] = F.col(f"_flag_{name}")
    out = rows.withColumns(columns).select(*docs.columns, "signal", "signal_id", *columns)
    return out.withColumns({name: F.coalesce(F.expr(mark), F.lit(False)) for name, mark in e.marks.items()})


def route(docs: DataFrame, engine: str, sources: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """extract() and decide(): each signal with risk, route, priority and confidence.

    sources: frames of further readings, each with the name of the id by which it is joined; a
    source that knows the signal counts as one that answered.
    """
    rows = extract(docs, engine).withColumn("enriched", F.lit(0))
    for k, (frame, key) in enumerate(sources):
        rows = rows.join(frame.withColumn(f"_known{k}", F.lit(1)), key, "left").withColumn("enriched", F.col("enriched") + F.coalesce(f"_known{k}", F.lit(0))).drop(f"_known{k}")
    return decide(rows, engine)
