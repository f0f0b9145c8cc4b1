"""Run parameters: an INI of ordered, typed keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: The keys of an INI in the order in which they must come, with their types.
KEYS = {
    "SPECIES": str, "OUTPUT_DIR": str, "DRAFT_ASSEMBLY_FASTA": str, "SAM_DIR": str, "SAM_FILES": list, "RE_SITE_SEQ": str, "USE_REFERENCE": bool, "SIM_BIN_SIZE": int, "REF_ASSEMBLY_FASTA": str,
    "BLAST_FILE_HEAD": str, "DO_CLUSTERING": bool, "DO_ORDERING": bool, "DO_REPORTING": bool, "OVERWRITE_GLM": bool, "OVERWRITE_CLMS": bool, "CLUSTER_N": int, "CLUSTER_CONTIGS_WITH_CENS": list, "CLUSTER_MIN_RE_SITES": int,
    "CLUSTER_MAX_LINK_DENSITY": float, "CLUSTER_NONINFORMATIVE_RATIO": float, "CLUSTER_DRAW_HEATMAP": bool, "CLUSTER_DRAW_DOTPLOT": bool, "ORDER_MIN_N_RES_IN_TRUNK": int, "ORDER_MIN_N_RES_IN_SHREDS": int,
    "ORDER_DRAW_DOTPLOTS": bool, "REPORT_EXCLUDED_GROUPS": list, "REPORT_QUALITY_FILTER": float, "REPORT_DRAW_HEATMAP": bool,
}


@dataclass(frozen=True)
class Settings:
    """Values of an INI by key."""

    values: dict[str, object] = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.values[key]

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    def rows(self) -> list[tuple[str, str]]:
        return [(k, " ".join(map(str, v)) if isinstance(v, list) else str(v)) for k, v in self.values.items()]


class SettingsError(ValueError):
    """A line of an INI that cannot be used, with its number."""


def _typed(key: str, words: list[str], number: int):
    kind = KEYS[key]
    if kind is list:
        return words
    if len(words) != 1:
        raise SettingsError(f"line {number}: {key} takes one value")
    if kind is bool:
        if words[0] not in ("0", "1"):
            raise SettingsError(f"line {number}: {key} takes 0 or 1")
        return words[0] == "1"
    try:
        return kind(words[0])
    except ValueError as error:
        raise SettingsError(f"line {number}: {key} is no {kind.__name__}") from error


def parse(text: str) -> Settings:
    """Settings of an INI text: ``KEY = value ..`` in order; lines that begin with ``#`` are passed over."""
    values: dict[str, object] = {}
    due = iter(KEYS)
    for number, line in enumerate(text.splitlines(), 1):
        if line.startswith("#") or not line.strip():
            continue
        key, equals, rest = line.partition("=")
        key = key.strip()
        if not equals or key != (wanted := next(due, None)):
            raise SettingsError(f"line {number}: expected {wanted or 'nothing more'}")
        values[key] = _typed(key, rest.split(), number)
    if (missing := next(due, None)) is not None:
        raise SettingsError(f"missing: {missing}")
    ratio = values["CLUSTER_NONINFORMATIVE_RATIO"]
    if ratio != 0 and ratio <= 1:
        raise SettingsError("CLUSTER_NONINFORMATIVE_RATIO must be 0 or above 1")
    anchors = [w for w in values["CLUSTER_CONTIGS_WITH_CENS"] if w != "-1"]
    if len(anchors) > values["CLUSTER_N"]:
        raise SettingsError("more centromere contigs than clusters")
    return Settings(values)


def load(path: str) -> Settings:
    return parse(Path(path).read_text(encoding="utf-8"))


def without_comments(text: str) -> str:
    """An INI without comments and blank lines."""
    return "".join(f"{line}\n" for line in text.splitlines() if line and not line.startswith("#"))
