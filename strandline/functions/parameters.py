"""Parameters of a guide design with their defaults, limits and the formats they come in."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(name: str, value: float) -> None:
    if value <= 0:
        raise ValueError(f"{name} must be above 0, not {value}")


def not_negative(name: str, value: float) -> None:
    if value < 0:
        raise ValueError(f"{name} must be 0 or more, not {value}")


def share(name: str, value: float) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must lie between 0 and 1, not {value}")


@dataclass(frozen=True)
class Design:
    """What a design is asked for.  Fixed values: the defaults."""

    prefix: str = "guides"
    feature: str = "CDS"
    merge_within: int = 100
    min_identity: float = 95.0
    min_length: int = 1
    min_cds_length: int = 1
    check_reciprocal: bool = False
    relax_reciprocal: bool = False
    pam: str = ".NGG"
    length: int = 20
    offtarget_mismatch: int = 1
    offtarget_gap: int = 0
    offtarget_pamless: bool = True
    offtarget_pattern: str | None = None
    offtarget_edits: int = 4  # of hits that a pattern is held against
    gc_min: float = 0.3
    gc_max: float = 0.7
    max_insertion: int = 15
    min_within_n: int = 1
    min_within_fraction: float = 0.0
    screen_reference: bool = True
    sets: int = 1
    prioritise_nonredundant: bool = False
    set_cover: str = "LAR"
    cover_reachable: bool = False  # leave out targets that no passing guide hits
    accept_unset: bool = False
    renames: dict[str, dict[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("length", "sets"):
            positive(name, getattr(self, name))
        for name in ("merge_within", "min_length", "min_cds_length", "offtarget_mismatch", "offtarget_gap", "offtarget_edits", "max_insertion", "min_within_n", "min_identity"):
            not_negative(name, getattr(self, name))
        for name in ("gc_min", "gc_max", "min_within_fraction"):
            share(name, getattr(self, name))
        if self.gc_min > self.gc_max:
            raise ValueError("gc_min must not exceed gc_max")
        if self.set_cover not in ("LAR", "greedy"):
            raise ValueError(f"no such set cover: {self.set_cover!r}")

    def changed(self, **values) -> Design:
        return replace(self, **values)


def read_config(path: str) -> tuple[Design, dict[str, dict[str, str]]]:
    """The parameters of a configuration file's sections, and the sections that hold other
    names (look-ups: their lines as they stand).  Names are those of ``Design`` with ``-``
    or ``_``; values take the type of the default."""
    parser = configparser.ConfigParser(interpolation=None)
    with open(path) as f:
        parser.read_file(f)
    known, values, others = {f.name: f for f in fields(Design)}, {}, {}
    for section in parser.sections():
        for key, text in parser[section].items():
            name = key.replace("-", "_").replace(" ", "_")
            if name not in known:
                others.setdefault(section, {})[key] = text
                continue
            default = getattr(Design(), name)
            values[name] = (
                parser[section].getboolean(key) if isinstance(default, bool) else int(text) if isinstance(default, int)
                else float(text) if isinstance(default, float) else parsed_renames(text) if name == "renames" else text)
    return Design(**values), others


def parsed_renames(text: str) -> dict[str, dict[str, str]]:
    """``type:name=spelling,name=spelling;type:...`` as {type: {name: spelling}}."""
    out = {}
    for part in filter(None, (text or "").split(";")):
        kind, _, names = part.partition(":")
        out[kind.strip()] = dict(n.strip().split("=", 1) for n in names.split(","))
    return out


def renames(text: Column) -> Column:
    """The same of a column: an array of (feature, name, spelling)."""
    one = lambda part: F.transform(F.split(F.split_part(part, F.lit(":"), F.lit(2)), ","), lambda m: F.struct(F.split_part(part, F.lit(":"), F.lit(1)).alias("feature"), F.split_part(m, F.lit("="), F.lit(1)).alias("name"), F.split_part(m, F.lit("="), F.lit(2)).alias("spelling")))
    return F.flatten(F.transform(F.split(text, ";"), one))
