"""Column helpers for source citations in answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import py_round
from .text import strip, token_set

# What counts as a citation.
GROUP = r"\[[^\]\r\n]{1,80}\]"
CITED = r"(?i)\b(?:S|Source)\s*(\d+)\b"
WHOLE = r"(?i)\A\[\s*(?:S|Source)\s*\d+(?:\s*(?:,|;|&|\band\b)\s*(?:S|Source)\s*\d+)*\s*\]\z"
BULLET = r"\A(?:[-*+]\s+|\d+[.)]\s+)"


def plain_brackets(c: Column) -> Column:
    return F.translate(c, "【】［］", "[][]")


def _groups(c: Column) -> Column:
    return F.regexp_extract_all(plain_brackets(F.coalesce(c, F.lit(""))), F.lit(GROUP), F.lit(0))


def _ids(group: Column) -> Column:
    return F.regexp_extract_all(group, F.lit(CITED), F.lit(1))


def cited_ids(c: Column) -> Column:
    """Source numbers of all citation groups, in order, with repeats."""
    return F.flatten(F.transform(F.filter(_groups(c), lambda g: g.rlike(WHOLE)), _ids))


def canonical(c: Column) -> Column:
    """Each citation group as [S1] [S2]; other brackets as they are."""
    shown = F.transform(_groups(c), lambda g: F.when(g.rlike(WHOLE), F.array_join(F.transform(_ids(g), lambda i: F.concat(F.lit("[S"), i, F.lit("]"))), " ")).otherwise(g))
    between = F.split(plain_brackets(c), GROUP, -1)
    return F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def claim_coverage(c: Column) -> Column:
    """Share of claims that carry a citation. Headings, fences and bold lines are no claims; a bullet line is one; other
    lines are cut into sentences; claims have three distinct tokens or more. 1 for a blank answer, 0 without a claim."""
    lines = F.transform(F.split(c, "\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), strip)
    idle = lambda x: (x == "") | x.startswith("#") | x.startswith("```") | (x.startswith("**") & x.endswith("**"))
    cut = lambda x: F.when(x.rlike(BULLET), F.array(F.regexp_replace(x, BULLET, ""))).otherwise(F.split(x, r"(?U)(?<=[.!?])\s+|\n+"))
    claims = F.filter(F.flatten(F.transform(F.filter(lines, lambda x: ~idle(x)), cut)), lambda p: F.size(token_set(p)) >= 3)
    share = lambda all_: F.size(F.filter(all_, lambda p: F.size(cited_ids(p)) > 0)) / F.size(all_)
    counted = F.transform(F.array(claims), lambda all_: F.when(F.size(all_) > 0, share(all_)))[0]
    return py_round(F.coalesce(counted, F.when(strip(c) == "", F.lit(1.0)).otherwise(F.lit(0.0))), 3)


def citation_validity(answer: Column, shown: Column) -> Column:
    """Share of cited numbers from 1 to the number of sources shown; null without citations."""
    ids = cited_ids(answer)
    known = F.filter(ids, lambda i: i.rlike(r"\A[1-9]\d{0,8}\z") & (i.cast("long") <= shown))
    return F.when(F.size(ids) > 0, py_round(F.size(known) / F.size(ids), 3))


_ONE = re.compile(r"(?:S|Source)\s*(\d+)", re.IGNORECASE)
_FENCE = re.compile(r"```(?:json)?(.*)```", re.DOTALL)


def _object(text: str) -> dict:
    """The JSON object of a model's output: all of it, perhaps fenced, or from its first to its last brace."""
    fenced = _FENCE.fullmatch(text.strip())
    for candidate in (fenced[1].strip() if fenced else text.strip(), text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            found = json.loads(candidate)
        except json.JSONDecodeError:
            continue
        if not isinstance(found, dict):
            raise ValueError("not an object")
        return found
    raise ValueError("no JSON object")


def _bullet(item, n_sources: int) -> str:
    if not isinstance(item, dict) or not isinstance(item.get("claim"), str) or not isinstance(item.get("source_ids"), list):
        raise ValueError("an item needs a claim and sources")
    claim, sources = " ".join(item["claim"].split()).lstrip("-*+ "), []
    for s in item["source_ids"]:
        m = _ONE.fullmatch(s.strip()) if isinstance(s, str) else None
        if not m or m[1] not in {str(i + 1) for i in range(n_sources)}:
            raise ValueError("an unknown source")
        sources.append(f"[S{m[1]}]")
    if not claim or not sources:
        raise ValueError("an item needs a claim and sources")
    end = claim[-1] if claim[-1] in ".!?" else ""
    return f"- {claim.removesuffix(end) if end else claim} {' '.join(dict.fromkeys(sources))}{end}"


def parse_answer(text: str | None, n_sources: int) -> tuple[bool | None, str | None, str | None, str | None]:
    """can_answer, rendered answer, reason, error."""
    try:
        found = _object(text or "")
        if not isinstance(found.get("can_answer"), bool):
            raise ValueError("can_answer must be true or false")
        if not found["can_answer"]:
            return False, "", " ".join(str(found.get("reason", "")).split())[:500], None
        items = found.get("items")
        if not isinstance(items, list) or not 1 <= len(items) <= 20:
            raise ValueError("1 to 20 items are needed")
        return True, "\n".join(_bullet(i, n_sources) for i in items), "", None
    except ValueError as e:
        return None, None, None, str(e)


@F.pandas_udf(T.StructType([T.StructField("can_answer", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("answer", "reason", "error"))]))
def structured_answer(text: pd.Series, n_sources: pd.Series) -> pd.DataFrame:
    """A model's JSON, checked strictly and rendered as cited bullets; error instead, where it isn't right."""
    rows = [parse_answer(t, 0 if n != n else int(n)) for t, n in zip(text, n_sources, strict=True)]
    return pd.DataFrame(rows, columns=["can_answer", "answer", "reason", "error"]).astype({"can_answer": "boolean"})
