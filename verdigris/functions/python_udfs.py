"""What column expressions can't do: recursive walks over JSON and exact case folding, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rendered(value: object, depth: int) -> str:
    """Nested JSON as labelled lines; two spaces a level."""
    if value is None:
        return ""
    lead = "  " * depth
    if isinstance(value, list):
        items = (_rendered(x, depth + 1).lstrip() for x in value)
        return "\n".join(f"{lead}- {x}" for x in items)
    if isinstance(value, dict):
        lines = []
        for key, x in value.items():
            nested = isinstance(x, dict | list)
            lines.append(f"{lead}{key}:" + ("\n" if nested else " ") + _rendered(x, depth + 1 if nested else 0))
        return "\n".join(lines)
    return str(value)


def _fold_hash(text: str) -> str:
    return hashlib.sha256(" ".join(text.casefold().split()).encode()).hexdigest()


def _strings(value: object):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _strings(x)


def _parsed(raw: str | None) -> object:
    """The object or array that the text holds as JSON; any other text, numbers and words like true and null too, is itself."""
    try:
        value = json.loads(raw)
    except (TypeError, ValueError):
        return raw
    return value if isinstance(value, dict | list) else raw


def _hashes(value: object) -> list[str]:
    """Hashes of the rendered value and of each string in it of five words or more, sorted."""
    return sorted({_fold_hash(_rendered(value, 0)), *(_fold_hash(s) for s in _strings(value) if len(s.split()) >= 5)})


@F.pandas_udf(T.StringType())
def render_content(raw: pd.Series) -> pd.Series:
    """Text, or an object or array as JSON, to the text that a model sees; field names stay as labels. Null stays null."""
    return raw.map(lambda r: None if r is None else _rendered(_parsed(r), 0))


@F.pandas_udf(T.StringType())
def render_json(raw: pd.Series) -> pd.Series:
    """render_content of a value of any type, given as JSON: a text is in quotes, true reads True, null is empty."""
    return raw.map(lambda r: None if r is None else _rendered(json.loads(r), 0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def render_all(raw: pd.Series) -> pd.Series:
    """render_content of each element; nulls in the array stay."""
    return raw.map(lambda values: None if values is None else [None if r is None else _rendered(_parsed(r), 0) for r in values])


@F.pandas_udf(T.StringType())
def row_hash(raw: pd.Series) -> pd.Series:
    """SHA-256 of a row given as JSON text, as JSON with sorted keys."""
    return raw.map(lambda r: None if r is None else hashlib.sha256(json.dumps(json.loads(r), sort_keys=True).encode()).hexdigest())


@F.pandas_udf(T.StringType())
def sorted_json(raw: pd.Series) -> pd.Series:
    """JSON text with sorted keys."""
    return raw.map(lambda r: None if r is None else json.dumps(json.loads(r), sort_keys=True))


def _first_object(text: str | None) -> dict | None:
    decoder, at = json.JSONDecoder(), -1 if text is None else text.find("{")
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def _answer(value: object, kind: str, keys: list[str]) -> str | None:
    """The key that a JSON value names; null if it names none."""
    if kind == "choice":
        key = value.strip().strip("\"'") if isinstance(value, str) else None
    elif kind == "noul":
        word = value.strip().lower() if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else None
        key = word if word in ("true", "false") else None
    else:
        whole = isinstance(value, int) and not isinstance(value, bool)
        key = str(value) if whole else str(int(value)) if isinstance(value, str) and value.strip().isdigit() else None
    return key if key in keys else None


@F.pandas_udf(T.StructType().add("parse_ok", T.BooleanType()).add("answers", T.ArrayType(T.StringType())))
def parsed_answers(text: pd.Series, qids: pd.Series, kinds: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """Of free text and a record's questions: whether there is a JSON object, and each question's key out of it (null: none)."""
    out = []
    for t, ids, types, names in zip(text, qids, kinds, keys, strict=True):
        found = _first_object(t)
        out.append((found is not None, [_answer((found or {}).get(q), k, list(n)) for q, k, n in zip(ids, types, names, strict=True)]))
    return pd.DataFrame(out, columns=["parse_ok", "answers"])


@F.pandas_udf(T.StringType())
def casefold_hash(text: pd.Series) -> pd.Series:
    """text_hash with full Unicode case folding."""
    return text.map(lambda t: None if t is None else _fold_hash(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def state_hashes(raw: pd.Series) -> pd.Series:
    """Hashes of a state's rendered text and of each string in it of five words or more, sorted."""
    return raw.map(lambda r: None if r is None else _hashes(_parsed(r)))


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """The first JSON object in free text, as JSON; null without one. Text may follow it."""
    decoder = json.JSONDecoder()

    def first(t: str | None):
        at = -1 if t is None else t.find("{")
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(t, at)
                return json.dumps(found, ensure_ascii=False)
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return text.map(first)


def _gold(kind: str | None, label: object, options: list) -> str | None:
    """The key that a label names: an option id, true or false in any case, a level by number or by its text."""
    if kind == "noul":
        word = str(label).lower()
        return word if word in ("true", "false") else None
    if kind == "score":
        if isinstance(label, str) and label in options:
            return str(options.index(label))
        whole = not isinstance(label, bool) and str(label).strip().lstrip("-").isdigit()
        return str(int(label)) if whole and 0 <= int(label) < len(options) else None
    return label if kind == "choice" and isinstance(label, str) and label in options else None


def _labelled(raw: str) -> dict:
    try:
        top = json.loads(raw)
    except ValueError:
        top = None
    if not isinstance(top, dict) or not isinstance(top.get("questions"), dict):
        return {"state": None, "text": None, "text_sha256": None, "hashes": None, "schema_family": None, "notes": None, "questions": []}
    told = lambda v: None if v is None else _rendered(v, 0)
    asked = []
    for qid, q in top["questions"].items():
        q = q if isinstance(q, dict) else {}
        kind, criteria = q.get("type"), q.get("criteria")
        named = criteria if isinstance(criteria, dict) else {}
        options = list(named) if kind == "choice" else criteria if kind == "score" and isinstance(criteria, list) else []
        keys = options if kind == "choice" else ["false", "true"] if kind == "noul" else [str(k) for k in range(len(options))]
        said = [named.get(k) for k in keys] if kind in ("choice", "noul") else options
        asked.append({"qid": qid, "type": kind if isinstance(kind, str) else None, "instructions": told(q.get("instructions")), "keys": keys, "descriptions": [told(d) for d in said], "gold": _gold(kind, q.get("label"), options)})
    state = top.get("state")
    family = top.get("schema_family")
    text = _rendered(state, 0)
    return {"state": json.dumps(state, ensure_ascii=False), "text": text, "text_sha256": _fold_hash(text), "hashes": _hashes(state), "schema_family": family if isinstance(family, str) else None, "notes": told(top.get("notes")), "questions": asked}


_TEXTS = T.ArrayType(T.StringType())
_QUESTION = T.StructType().add("qid", "string").add("type", "string").add("instructions", "string").add("keys", _TEXTS).add("descriptions", _TEXTS).add("gold", "string")


@F.pandas_udf(T.StructType().add("state", "string").add("text", "string").add("text_sha256", "string").add("hashes", _TEXTS).add("schema_family", "string").add("notes", "string").add("questions", T.ArrayType(_QUESTION)))
def labelled_request(raw: pd.Series) -> pd.DataFrame:
    """A labelled request as JSON, with every value's own type: state as JSON, its text, the text's hash and all hashes, and the questions with texts and gold keys (null: the label names none). What is no request has no questions."""
    return pd.DataFrame([_labelled(r) for r in raw], columns=["state", "text", "text_sha256", "hashes", "schema_family", "notes", "questions"])


def _question_problem(q: object, most: int) -> str | None:
    kind, criteria = (q.get("type"), q.get("criteria")) if isinstance(q, dict) else (None, None)
    if kind == "noul":
        return None if criteria is None or isinstance(criteria, dict) and set(criteria) <= {"true", "false"} else "noul_keys"
    if kind not in ("choice", "score"):
        return "unknown_type"
    if not isinstance(criteria, dict if kind == "choice" else list) or not 1 <= len(criteria) <= most:
        return "option_count"
    return "empty_option_id" if kind == "choice" and "" in criteria else None


def _request(raw: str | None) -> dict:
    """MAX_QUESTIONS and MAX_OPTIONS of functions.questions bound what a request may ask."""
    from verdigris.functions.questions import MAX_OPTIONS, MAX_QUESTIONS

    try:
        top = json.loads(raw)
    except (TypeError, ValueError):
        top = None
    asked = top.get("questions") if isinstance(top, dict) and "state" in top else None
    if not isinstance(asked, dict):
        return {"problem": "no_request", "text": None, "questions": None}
    problems = [p for q in asked.values() if (p := _question_problem(q, MAX_OPTIONS))]
    if not 1 <= len(asked) <= MAX_QUESTIONS:
        problems = ["question_count"]
    if problems:
        return {"problem": problems[0], "text": None, "questions": None}
    told = lambda v: None if v is None else _rendered(v, 0)
    out = []
    for qid, q in asked.items():
        kind, criteria = q["type"], q.get("criteria") or {}
        keys = list(criteria) if kind == "choice" else ["false", "true"] if kind == "noul" else [str(k) for k in range(len(criteria))]
        said = [criteria.get(k) for k in keys] if kind != "score" else criteria
        out.append({"qid": qid, "type": kind, "instructions": told(q.get("instructions")) or "", "keys": keys, "descriptions": [told(d) for d in said]})
    return {"problem": None, "text": _rendered(top["state"], 0), "questions": out}


_ASKED = T.StructType().add("qid", "string").add("type", "string").add("instructions", "string").add("keys", _TEXTS).add("descriptions", _TEXTS)


@F.pandas_udf(T.StructType().add("problem", "string").add("text", "string").add("questions", T.ArrayType(_ASKED)))
def request(raw: pd.Series) -> pd.DataFrame:
    """A request as JSON: the state's text and the questions with their texts, in order; or the first problem with it."""
    return pd.DataFrame([_request(r) for r in raw], columns=["problem", "text", "questions"])
