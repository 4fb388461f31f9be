"""Plain Python versions of operators, for comparison on small tables."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from datetime import date


def _clean(v):
    v = v.strip() if isinstance(v, str) else v
    return None if v is None or v.lower() in ("", "null", "na", "n/a") else v


def _type(v):
    if v.lower() in ("true", "false"):
        return "boolean"
    if re.fullmatch(r"-?[0-9]+", v):
        return "integer"
    if re.fullmatch(r"-?[0-9]+\.[0-9]+|-?[0-9]+[eE][+-]?[0-9]+", v):
        return "float"
    if re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", v):
        try:
            date.fromisoformat(v[:10])
            return "date"
        except ValueError:
            pass
    return "string"


def quality(rows, columns, history):
    latest = {}
    for r in rows:
        latest[r["dataset_id"]] = max(latest.get(r["dataset_id"], r["snapshot_at"]), r["snapshot_at"])
    records = {(r["dataset_id"], r["row_no"]): json.loads(r["row_json"]) for r in rows if r["snapshot_at"] == latest[r["dataset_id"]]}
    by_set = defaultdict(list)
    for (d, _), rec in records.items():
        by_set[d].append(rec)
    claims = {}
    for c in columns:
        k = c["dataset_id"], c["name"]
        if k not in claims or claims[k]["updated_at"] <= c["updated_at"]:
            claims[k] = c
    out = set()
    for (d, name), c in claims.items():
        if d not in by_set:
            continue
        values = [_clean(r.get(name)) for r in by_set[d]]
        full = [v for v in values if v is not None]
        kinds = Counter(map(_type, full))
        if not kinds:
            kind = "null"
        elif len(kinds) == 1:
            kind = next(iter(kinds))
        elif set(kinds) == {"integer", "float"}:
            kind = "float"
        else:
            kind = next((k for k, n in kinds.items() if n > 0.8 * len(values)), "mixed")
        if abs(c["null_pct"] - (len(values) - len(full)) / len(values)) > 0.01:
            out.add((d, name, "null_pct"))
        if c["cardinality"] != len(set(full)):
            out.add((d, name, "cardinality"))
        if c["inferred_type"] != kind:
            out.add((d, name, "inferred_type"))
        if kind in ("integer", "float"):
            num = [float(v) for v in full if _type(v) in ("integer", "float")]
            try:
                same = float(c["min_value"]) == min(num) and float(c["max_value"]) == max(num)
            except (TypeError, ValueError):
                same = False
            if not same:
                out.add((d, name, "range"))
        if kind in ("string", "date"):
            shapes = Counter(re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", v)) for v in full)
            top = max(shapes.values())
            if 0.9 * len(full) <= top < len(full):
                out.add((d, name, "pattern"))
    loads = defaultdict(dict)
    for h in history:
        try:
            loads[h["dataset_id"]][h["snapshot_at"]] = {c["name"]: c for c in json.loads(h["columns_json"])}
        except (ValueError, TypeError):
            continue
    for d, by_time in loads.items():
        if len(by_time) < 2:
            continue
        old, new = (by_time[t] for t in sorted(by_time)[-2:])
        for name in old.keys() | new.keys():
            a, b = old.get(name), new.get(name)
            if not a or not b or a["type"] != b["type"] or abs(a["nullPct"] - b["nullPct"]) > 0.05:
                out.add((d, name, "drift"))
            else:
                lo, hi = sorted((a["cardinality"], b["cardinality"]))
                if lo != hi and hi >= 2 * lo:
                    out.add((d, name, "drift"))
    return out
