"""Ids, paths and option strings as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The id conventions of the two kinds of split.
DETECTION_ID = {"load": r"(?i)/(heavy|med|light)_vel", "vel": r"(?i)vel(\d+)", "noise": r"(?i)_(clean|noise\w*)"}
CLASSIFICATION_ID = {"load": r"(?i)/(heavy|med|light)[-_]vel", "vel": r"(?i)vel(\d+)", "noise": r"(?i)[_/](clean|noise[^_/]*)"}
CHANNEL_SUFFIX = r"(?:::|\||#)col=(\d+)$"
STRICT_SUFFIX = r"::col=(\d+)$"


def parse_id(id_: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """load, vel, noise and noise_cls of an id; missing parts are empty, missing noise is clean."""
    noise = F.lower(F.regexp_extract(id_, patterns["noise"], 1))
    noise = F.when(noise == "", F.lit("clean")).otherwise(noise)
    return {
        "load": F.lower(F.regexp_extract(id_, patterns["load"], 1)),
        "vel": F.regexp_extract(id_, patterns["vel"], 1),
        "noise": noise,
        "noise_cls": F.when(F.startswith(noise, F.lit("noise")), F.lit("noise")).otherwise(F.lit("clean")),
    }


def path_parts(path: Column) -> Column:
    """Path components; repeated slashes and single dots vanish, a leading slash stays a part."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def fault_from_path(path: Column) -> Column:
    """The part after "abnormal", else "normal" if a part says so, else null."""
    parts = path_parts(F.lower(path))
    at = F.array_position(parts, "abnormal")
    return F.when(at > 0, F.get(parts, at.cast("int"))).when(F.array_contains(parts, "normal"), F.lit("normal"))


def condition_from_path(path: Column) -> Column:
    """Two parts after "abnormal"; one after "normal" (or "normal"); else the part before the last."""
    low, parts = path_parts(F.lower(path)), path_parts(path)
    abnormal, normal = F.array_position(low, "abnormal").cast("int"), F.array_position(low, "normal").cast("int")
    return F.when(abnormal > 0, F.get(parts, abnormal + 1)).when(normal > 0, F.coalesce(F.get(parts, normal), F.lit("normal"))).otherwise(F.get(parts, F.size(parts) - 2))


def id_suffix(path: Column) -> Column:
    """The last three parts of a path, or as many as it has."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "/")


def clean_path(path: Column) -> Column:
    """Without invisible marks, wrapping quotes, and separators at its end."""
    bare = F.trim(F.regexp_replace(path, "[﻿​]", ""))
    bare = F.regexp_replace(bare, r"""^["']+|["']+$""", "")
    return F.regexp_replace(bare, r"[：:；;，,\s]+$", "")


def split_channel(path: Column, pattern: str = CHANNEL_SUFFIX) -> tuple[Column, Column]:
    """The path without its channel suffix, and the channel number or null."""
    k = F.regexp_extract(path, pattern, 1)
    return F.regexp_replace(path, pattern, ""), F.when(k != "", k.cast("int"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def file_name(id_: Column) -> Column:
    """An id as a file name."""
    return F.regexp_replace(id_, r"[/\\]", "__")


def encode_paths(paths: Column) -> Column:
    return F.to_json(paths)


def decode_paths(cell: Column, lenient: bool = False) -> Column:
    """A JSON list of paths; null where it is none. Lenient: JSON in JSON, bracketed or single paths, objects with a path key."""
    strict = F.from_json(cell, "array<string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    if not lenient:
        return F.when(F.trim(cell).startswith("["), strict)
    item = lambda x: F.when(
        F.trim(x).startswith("{"),
        F.concat(
            F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("path", "file", "filepath", "src", "p")]),
            F.coalesce(F.concat(F.lit("::col="), F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("col", "channel", "ch")])), F.lit("")),
        ),
    ).otherwise(x)
    text = F.trim(cell)
    inner = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    unwrapped = F.when(F.startswith(text, F.lit('"')), F.get(inner, 0)).otherwise(text)
    listed = F.when(F.startswith(unwrapped, F.lit("[")), F.from_json(unwrapped, "array<string>"))
    values = F.when(F.startswith(unwrapped, F.lit("{")), F.map_values(F.from_json(unwrapped, "map<string,string>")))
    bracketed = F.when(
        F.startswith(unwrapped, F.lit("[")),
        F.transform(F.split(F.regexp_replace(unwrapped, r"^\[|\]$", ""), ","), lambda p: F.regexp_replace(F.trim(p), r"""^["']+|["']+$""", "")),
    )
    nothing = F.when(F.coalesce(unwrapped, F.lit("")).isin("", "None"), F.array().cast("array<string>"))
    whole = lambda a: F.when(F.exists(a, F.isnull), F.lit(None)).otherwise(a)
    return F.transform(F.coalesce(nothing, whole(listed), values, bracketed, F.array(unwrapped)), item)


# Where a sample's seven channels lie if only its root and stem are known.
DEFAULT_CHANNELS = (
    *[f"audio/{{stem}}_{source}.wav" for source in ("recorder", "ios", "android")],
    *[f"vibration/{{stem}}_vibration.csv::col={c}" for c in range(1, 5)],
)


def default_paths(root: Column, stem: Column) -> Column:
    """The seven channel paths of a sample by its root folder and stem."""
    at = lambda p: F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/" + p.split("{stem}")[0]), stem, F.lit(p.split("{stem}")[1]))
    return F.array(*[at(p) for p in DEFAULT_CHANNELS])


def csv_options(text: str) -> list[str]:
    """Comma-separated options: stripped, lower case, without empty ones."""
    return [p.strip().lower() for p in text.split(",") if p.strip()]


def json_options(text: str | None) -> dict:
    """Options as a JSON object; ValueError for anything else."""
    out = json.loads(text) if text else {}
    if not isinstance(out, dict):
        raise ValueError("options must be a JSON object")
    return out


LOADS, NOISES = ("heavy", "med", "light"), ("clean", "noise")


def combos(spec: str) -> list[tuple[str, str]]:
    """(load, noise class) pairs: all of them, none, or those listed as load-noise."""
    every = [(load, noise) for load in LOADS for noise in NOISES]
    wanted = csv_options(spec)
    if wanted in ([], ["all"]):
        return every
    if wanted == ["none"]:
        return []
    pairs = [tuple(w.split("-")) for w in wanted]
    if any(p not in every for p in pairs):
        raise ValueError(f"combos must be load-noise pairs of {LOADS} and {NOISES}, not {spec!r}")
    return list(dict.fromkeys(pairs))
