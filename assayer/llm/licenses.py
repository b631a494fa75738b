"""License scan by ordered signature rules, in DataFrame functions only.

Each rule is a regular expression over the lower-cased text (blanks squeezed), gated by literal keywords, with a label
and a class: 0 a machine-readable tag, 1 a notice (granting words, a license field or a license's address), 2 a mention.
A text without any of the gate words is not looked at; in one with, only rules of which it contains a keyword are run.
The gate words are derived from the rules: each match of a rule holds one of them. Both look at the squeezed text.

Overlaps: detections are ordered by start, then longer first, then class. One that lies within an earlier one of its own
or a better class is suppressed. So 'licensed under the gnu lesser general public license, version 3' is one detection,
and the shorter names inside it are none.

Beside the rules stand three base phrases of words (mit license, apache license, general public license), counted at all
their places. Null and empty texts have no words and no labels; each input row gives one row.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .native import let

#: Characters that no word holds, and the base phrases with their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

WEIGHT = {0: 1.0, 1: 0.9, 2: 0.6}
BASE_WEIGHT = 0.5

_V = r",? ?(?:\([al]?gpl\),? ?)?(?:version |ver\.? ?|v\.? ?)?"
_END = r"(?![\w.]*\d)"
_L = r"licen[sc]e"

#: label, name, tag, address
FAMILIES = [
    ("mit", rf"(?:mit|expat)(?: open source)? {_L}", r"mit", r"opensource\.org/licenses/mit"),
    ("mit-0", rf"mit no attribution(?: {_L})?|mit-0(?: {_L})?", r"mit-0", r"github\.com/aws/mit-0"),
    ("x11", rf"x11 {_L}", r"x11", r"spdx\.org/licenses/x11"),
    ("isc", rf"isc {_L}", r"isc", r"opensource\.org/licenses/isc"),
    ("0bsd", rf"(?:zero[- ]clause|0-clause) bsd(?: {_L})?|0bsd(?: {_L})?", r"0bsd", r"opensource\.org/licenses/0bsd"),
    ("bsd-2-clause", rf"(?:simplified bsd|(?:2|two)[- ]clause bsd|bsd (?:2|two)[- ]clause)(?: {_L})?", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", rf"(?:(?:new|modified|revised) bsd|(?:3|three)[- ]clause bsd|bsd (?:3|three)[- ]clause)(?: {_L})?", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", rf"(?:original bsd|(?:4|four)[- ]clause bsd|bsd (?:4|four)[- ]clause)(?: {_L})?", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", rf"bsd(?:[- ]style)? {_L}", r"bsd", r"opensource\.org/licenses/bsd-license"),
    ("apache-1.0", rf"apache(?: software)? {_L}{_V}1\.0{_END}", r"apache-1\.0", r"apache\.org/licenses/license-1\.0"),
    ("apache-1.1", rf"apache(?: software)? {_L}{_V}1\.1{_END}", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", rf"apache(?: software)? {_L}{_V}2(?:\.0)?{_END}|apache[- ]2\.0(?: {_L})?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache", rf"apache(?: software)? {_L}", r"apache", r"apache\.org/licenses/?(?![\w/])"),
    ("gpl-1.0", rf"(?:gnu )?(?:general public {_L}|gpl){_V}1(?:\.0)?{_END}", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", rf"(?:gnu )?(?:general public {_L}|gpl){_V}2(?:\.0)?{_END}", r"gpl-2\.0(?:-only)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-2.0-or-later", rf"(?:gnu )?(?:general public {_L}|gpl){_V}2(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later(?: version)?", r"gpl-2\.0(?:-or-later|\+)", r"spdx\.org/licenses/gpl-2\.0-or-later"),
    ("gpl-3.0", rf"(?:gnu )?(?:general public {_L}|gpl){_V}3(?:\.0)?{_END}", r"gpl-3\.0(?:-only)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-3.0-or-later", rf"(?:gnu )?(?:general public {_L}|gpl){_V}3(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later(?: version)?", r"gpl-3\.0(?:-or-later|\+)", r"spdx\.org/licenses/gpl-3\.0-or-later"),
    ("gpl", rf"(?:gnu )?general public {_L}|gnu gpl|(?<![\w.-])gpl(?![\w.-])", r"gpl", r"gnu\.org/(?:licenses/gpl|copyleft/gpl)(?![-\w])"),
    ("lgpl-2.0", rf"(?:gnu )?(?:(?:library|lesser) general public {_L}|lgpl){_V}2(?:\.0)?{_END}", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("lgpl-2.1", rf"(?:gnu )?(?:(?:library|lesser) general public {_L}|lgpl){_V}2\.1{_END}", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lesser general public {_L}|lgpl){_V}3(?:\.0)?{_END}", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", rf"(?:gnu )?(?:library|lesser) general public {_L}|(?:gnu )?lgpl", r"lgpl", r"gnu\.org/(?:licenses/lgpl|copyleft/lesser)(?![-\w])"),
    ("agpl-3.0", rf"(?:gnu )?(?:affero general public {_L}|agpl){_V}3(?:\.0)?{_END}", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", rf"(?:gnu )?affero general public {_L}|(?:gnu )?agpl", r"agpl", r"gnu\.org/licenses/agpl(?![-\w])"),
    ("gfdl", rf"(?:gnu )?free documentation {_L}(?:{_V}1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("mpl-1.1", rf"(?:mozilla public {_L}|mpl){_V}1\.1{_END}", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", rf"(?:mozilla public {_L}|mpl){_V}2(?:\.0)?{_END}", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl", rf"mozilla public {_L}", r"mpl", r"mozilla\.org/mpl/?(?![\w/])"),
    ("epl-1.0", rf"eclipse public {_L}{_V}1(?:\.0)?{_END}", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", rf"eclipse public {_L}{_V}2(?:\.0)?{_END}", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", rf"common development and distribution {_L}(?:{_V}1\.0)?", r"cddl-1\.0", r"opensource\.org/licenses/cddl"),
    ("eupl-1.2", rf"european union public {_L}(?:{_V}1\.2)?", r"eupl-1\.2", r"joinup\.ec\.europa\.eu/[\w/]*eupl"),
    ("artistic-1.0", rf"artistic {_L}{_V}1(?:\.0)?{_END}", r"artistic-1\.0", r"opensource\.org/licenses/artistic-license-1\.0"),
    ("artistic-2.0", rf"artistic {_L}{_V}2(?:\.0)?{_END}", r"artistic-2\.0", r"opensource\.org/licenses/artistic-2\.0"),
    ("zlib", rf"zlib(?:/libpng)? {_L}", r"zlib", r"opensource\.org/licenses/zlib"),
    ("bsl-1.0", rf"boost software {_L}(?:{_V}1\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("unlicense", r"(?:the )?unlicense(?!d)", r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("cc0-1.0", r"cc0(?:[- ]1\.0)?(?: universal)?|creative commons zero(?: v?1\.0)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("odbl-1.0", rf"open (?:data commons open )?database {_L}(?:{_V}1\.0)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("ofl-1.1", rf"(?:sil )?open font {_L}(?:{_V}1\.1)?", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("python-2.0", rf"python software foundation {_L}(?:{_V}2)?|psf {_L}", r"python-2\.0|psf-2\.0", r"python\.org/psf/license"),
    ("openrail", rf"(?:creativeml |bigscience |bigcode )?(?:open)?rail(?:\+\+)?(?:-m)? {_L}", r"openrail(?:\+\+)?", r"licenses\.ai"),
    ("public-domain", r"(?:dedicated to|placed (?:in|into)|released (?:in|into)|in) the public domain", r"licenseref-public-domain", r"creativecommons\.org/publicdomain/mark"),
    ("all-rights-reserved", r"all rights (?:are )?reserved", r"licenseref-all-rights-reserved", r"licenseref:all-rights-reserved"),
]

_CC_WORDS = {"by": "attribution", "sa": "share[- ]?alike", "nc": "non-?commercial", "nd": "no-?deriv(?:ative)?s?(?: works)?"}


def _creative_commons() -> list[tuple[str, str, str, str]]:
    """The attribution licenses: six kinds, each with five versions and without one."""
    out = []
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        parts = kind.split("-")
        long_name, short = "[- ]".join(_CC_WORDS[p] for p in parts), "[- ]".join(parts)
        more = "(?![- ](?:sa|nc|nd|share|non|no-?deriv))"
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0", ""):
            at = v.replace(".", r"\.")
            tail = rf"[- ,]*(?:version |v\.? ?)?{at}{_END}(?: international| unported| generic)?(?: {_L})?" if v else rf"{more}(?: {_L})?"
            name = rf"(?:cc|creative commons)[- ]{short}{tail}|creative commons {long_name}{tail}"
            out.append((f"cc-{kind}-{v}".rstrip("-"), name, rf"cc-{kind}-{at}" if v else rf"cc-{kind}", rf"creativecommons\.org/licenses/{kind}/{at}" if v else rf"creativecommons\.org/licenses/{kind}/?(?![\w/])"))
    return out


_TERMS = r"(?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


#: So many texts at most are spelled out for a part of an expression, and what literals should not be a part of, as plain text holds it often.
MOST = 12
COMMON = [" or later version", "1.1"]


def _texts(item) -> set[str] | None:
    """All texts that a parsed item matches, if they are few."""
    kind, value = item
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if kind is sre.LITERAL:
        return {chr(value)}
    if kind is sre.IN and all(k is sre.LITERAL for k, _ in value):
        return {chr(v) for _, v in value}
    if kind is sre.SUBPATTERN:
        return _spelled(value[3])
    if kind is sre.BRANCH:
        parts = [_spelled(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is sre.MAX_REPEAT and value[0] in (0, 1) and value[1] == 1:
        part = _spelled(value[2])
        return None if part is None else part | ({""} if value[0] == 0 else set())
    return None


def _spelled(items) -> set[str] | None:
    out = {""}
    for item in items:
        t = _texts(item)
        if t is None or len(out) * len(t) > MOST:
            return None
        out = {a + b for a in out for b in t}
    return out


def shortest(words) -> list[str]:
    """Without those that contain another."""
    words = set(words)
    return sorted(w for w in words if not any(v != w and v in w for v in words))


def _best(items) -> list[str]:
    """Of the sets of literals that every match holds one of, the one with long and few literals; empty if there is none."""
    found, run = [], {""}
    for item in items:
        t = _texts(item)
        run = {a + b for a in run for b in t} if t is not None and len(run) * len(t) <= MOST else t or {""}
        found.append(shortest(run))
        kind, value = item
        if t is None and kind is sre.SUBPATTERN:
            found.append(_best(value[3]))
        elif t is None and kind is sre.BRANCH:
            parts = [_best(p) for p in value[1]]
            found.append(shortest(w for p in parts for w in p) if all(parts) else [])
        elif t is None and kind is sre.MAX_REPEAT and value[0] > 0:
            found.append(_best(value[2]))
    usable = [w for w in found if w and "" not in w]
    return max(usable, key=lambda w: (not any(x in c for x in w for c in COMMON), min(5, *map(len, w)), -len(w), min(map(len, w))), default=[])


def alternatives(pattern: str) -> list[str]:
    """The expression cut at its outer bars; no rule has a bar or a bracket in a class or escaped, but for parentheses."""
    out, depth, last = [""], 0, ""
    for c in pattern:
        depth += (c == "(" and last != "\\") - (c == ")" and last != "\\")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
        last = c
    return out


def literals(pattern: str) -> list[str]:
    """Literals of which every match of the expression holds at least one: those of each alternative."""
    parts = [_best(_parser.parse(p)) for p in alternatives(pattern)]
    if not all(parts):
        raise ValueError(f"no literal in {pattern}")
    return shortest(w for p in parts for w in p)


def gate() -> list[str]:
    """Literals of which every match of every rule holds one: tags stand only beside 'licen', names and addresses also alone."""
    return shortest(["licen"] + [w for _, name, _, address in FAMILIES + _creative_commons() for part in (name, address) for w in literals(part)])


def rules() -> list[tuple[str, list[str], int, str]]:
    """label, keywords, class and expression of every rule: six signatures for each license. Every match of a rule holds
    one of its keywords; name and tag have their own."""
    out = []
    for label, name, tag, address in FAMILIES + _creative_commons():
        named, tagged = literals(name), literals(tag)
        out += [
            (label, ["spdx-license-identifier"], 0, rf"spdx-license-identifier: ?(?:\(?[\w.+-]+ (?:or|and) )?(?:{tag})(?![\w.+-])"),
            (label, named, 1, rf"\b(?:dual[- ])?licen[sc]ed (?:to you )?under {_TERMS}(?:{name})"),
            (label, named, 1, rf"\b(?:released|distributed|available|published|provided|covered|governed|redistribute[sd]?)(?: by| under)+ {_TERMS}(?:{name})"),
            (label, shortest(named + tagged), 1, rf"\blicen[sc]es?(?: type| name)? ?[:=] ?[\"']?(?:the )?(?:{name}|(?:{tag})(?![\w.+-]))"),
            (label, literals(address), 1, rf"https?://(?:www\.)?(?:{address})"),
            (label, named, 2, rf"(?<![\w-])(?:{name})"),
        ]
    return out


def groups() -> list[tuple[list[str], list]]:
    """The rules of licenses whose labels begin alike, and roots: without one of them in the text no rule's keyword is there."""
    kin: dict[str, list] = {}
    for rule in rules():
        kin.setdefault(rule[0].split("-")[0] if rule[2] else "", []).append(rule)
    return [(shortest(w for r in of for w in r[1]), of) for of in kin.values()]


def _spans(flat: Column, rule: Column) -> Column:
    """start, end, class and label of each match of the rule: texts between and in matches add up to positions."""
    def walk(s: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(s["between"], i))
            end = start + F.length(F.get(s["match"], i))
            one = F.struct(start.alias("start"), (-end).alias("neg_end"), rule["class"].alias("class"), rule["label"].alias("label"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

        none = F.array().cast("array<struct<start:int,neg_end:int,class:int,label:string>>")
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        many = F.aggregate(F.sequence(F.lit(0), F.size(s["match"]) - 1), zero, step)["out"]
        return F.when(F.size(s["match"]) > 0, many).otherwise(none)

    found = F.struct(F.regexp_extract_all(flat, rule["pattern"], F.lit(0)).alias("match"), F.split(flat, rule["pattern"], -1).alias("between"))
    return let(found, walk)


def _detections(lower: Column) -> Column:
    texts = lambda words: F.array(*[F.lit(w) for w in words])
    rule = lambda label, k, c, p: F.struct(F.lit(label).alias("label"), texts(k).alias("keywords"), F.lit(c).alias("class"), F.lit(p).alias("pattern"))
    table = F.array(*[F.struct(texts(roots).alias("roots"), F.array(*[rule(*x) for x in of]).alias("rules")) for roots, of in groups()])

    def of(flat: Column) -> Column:
        some = lambda words: F.exists(words, lambda w: F.contains(flat, w))
        kin = F.filter(table, lambda g: some(g["roots"]))
        live = F.filter(F.flatten(F.transform(kin, lambda g: g["rules"])), lambda r: some(r["keywords"]))
        return F.array_sort(F.flatten(F.transform(live, lambda r: _spans(flat, r))))

    def keep(found: Column) -> Column:
        """One pass: the furthest end so far of class 0, 0 to 1, and 0 to 2 tells whether a detection lies within one."""
        def step(acc: Column, x: Column) -> Column:
            end, c = -x["neg_end"], x["class"]
            inside = F.get(acc["far"], c) >= end
            far = F.transform(acc["far"], lambda e, i: F.when((i >= c) & ~inside, F.greatest(e, end)).otherwise(e))
            one = F.struct(x["start"].alias("start"), end.alias("end"), c.alias("class"), x["label"].alias("label"))
            return F.struct(far.alias("far"), F.when(inside, acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

        zero = F.struct(F.array(F.lit(-1), F.lit(-1), F.lit(-1)).alias("far"), F.array().cast("array<struct<start:int,end:int,class:int,label:string>>").alias("out"))
        return F.aggregate(found, zero, step)["out"]

    def gated(flat: Column) -> Column:
        some = F.lit(False)
        for g in gate():
            some = some | F.contains(flat, F.lit(g))
        return F.when(some, keep(of(flat)))

    return let(F.regexp_replace(lower, r"\s+", " "), gated)


def lowered(text: Column) -> Column:
    """A-Z alone in lower case; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections (start, end in the
    blank-squeezed lower-cased text, class, label; null where no gate word occurs)."""
    rows = id_text(docs, id_col, text_col).select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("low"))
    words_gate = F.contains("low", F.lit("license"))
    padded = F.concat(F.lit(" "), F.btrim(F.regexp_replace("low", NO_WORD, " ")), F.lit(" "))
    count = lambda c: F.regexp_count(c, F.lit("[^ ]+")).cast("long")
    n_words = F.regexp_count("low", F.lit(WORD)).cast("long")
    phrase = " (?=(?:" + "|".join(BASE) + ") )"

    def base(p: Column) -> Column:
        def of(parts: Column) -> Column:
            n = F.size(parts) - 1
            labels = F.array_compact(F.array(*[F.when(F.contains(p, F.lit(f" {w} ")), F.lit(v)) for w, v in BASE.items()]))
            return F.struct(n.cast("long").alias("n"), F.when(n > 0, count(F.get(parts, F.lit(0)))).alias("first"), F.when(n > 0, count(F.get(parts, n))).alias("rest"), labels.alias("labels"))

        return let(F.split(p, phrase, -1), of)

    rows = rows.select("doc_id", n_words.alias("n_words"), F.when(words_gate, let(padded, base)).alias("base"), _detections(F.col("low")).alias("detections"))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.array_distinct("base.labels")), none)
    both = F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce(F.col("detections.label"), none))))
    best = F.array_min(F.col("detections.class"))
    score = F.coalesce(*[F.when(best == c, F.lit(w)) for c, w in WEIGHT.items()], F.when(F.col("base.n") > 0, F.lit(BASE_WEIGHT)), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.coalesce("base.n", F.lit(0).cast("long")).alias("n_base"), F.col("base.first").alias("first_word"),
        F.when(F.col("base.n") > 0, F.col("n_words") - F.col("base.rest")).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"), "detections",
    )
