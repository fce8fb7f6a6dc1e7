"""Environments: files of one folder as one set of named tables."""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.graph import Unit
from tessera.sources import files, naming

OWNER_MARK = "_tessera_owned"


@dataclass
class EnvironmentSpec:
    """Where an environment's tables are; keys that its files do not declare can be added here."""

    source_id: str
    data_file: str
    extra_sources: list[str] = field(default_factory=list)
    declared: list[tuple[str, str, str, str]] = field(default_factory=list)  # table, column, other table, its column

    def paths(self, siblings: bool = True) -> list[str]:
        """The files, without repeats: the named ones, then structured files beside the first."""
        beside = [str(p) for p in sorted(Path(self.data_file).parent.iterdir()) if files.family(p.name)] if siblings and "://" not in self.data_file and Path(self.data_file).parent.is_dir() else []
        return list(dict.fromkeys([self.data_file, *self.extra_sources, *(beside if not self.extra_sources else [])]))


def load(spark: SparkSession, spec: EnvironmentSpec, siblings: bool = True) -> dict[str, Unit]:
    """Every table of the environment by a name that is unique whatever its case, at most 40."""
    taken: set[str] = set()
    units: dict[str, Unit] = {}

    def add(name: str, kind: str, df: DataFrame, title: str, declared: Sequence[tuple[str, str, str]] = ()) -> None:
        found = naming.reserve(name, kind, taken)
        units[found] = Unit(found, df, title, kind, tuple(df.columns[:1]), declared=list(declared))

    paths = spec.paths(siblings)
    texts = [p for p in paths if files.family(p) == "markdown"]
    blocks = files.read_markdown(spark, *texts) if texts else {}
    for path in paths:
        kind = files.family(path)
        if kind == "sqlite":
            for t in files.sqlite_tables(path):
                add(t, "sqlite_table", files.read_sqlite(spark, path, t), t, files.sqlite_foreign_keys(path, t))
        elif kind == "csv":
            add(naming.table_name(path), "csv_table", files.read_delimited(spark, path), Path(path).stem)
        elif kind == "excel":
            for sheet, df in files.read_workbook(spark, path).items():
                add(naming.table_name(path, sheet), "excel_sheet", df, f"{Path(path).stem}:{sheet}")
        elif kind == "markdown":
            for i, df in blocks[path].items():
                add(naming.table_name(path, i), "md_struct", df, f"{Path(path).stem}#{i}")
        elif kind == "parquet":
            add(naming.safe_identifier(Path(path).stem), "parquet", spark.read.parquet(path), Path(path).stem)
    for table, column, other, other_column in spec.declared:
        if table in units and other in units:
            units[table].declared.append((column, other, other_column))
    return units if len(units) <= files.MOST_TABLES else diverse(units)


def diverse(units: dict[str, Unit], most: int = files.MOST_TABLES) -> dict[str, Unit]:
    """At most `most` units: the largest of each format, eight large, eight small ones, then by rows."""
    rows = {n: u.df.count() for n, u in units.items()}
    down = sorted(units, key=lambda n: (-rows[n], n))
    first = {units[n].format: n for n in reversed(down)}
    small = [n for n in sorted(units, key=lambda n: (rows[n], n)) if rows[n] >= 3][:8]
    order = dict.fromkeys([*first.values(), *down[:8], *small, *down])
    return {n: units[n] for n in list(order)[:most]}


def save_scratch(units: dict[str, Unit], folder: str, sources: Sequence[str]) -> None:
    """Write the tables under a folder of their own; a source's folder or one that is not owned is refused."""
    at = Path(folder).resolve()
    if any(Path(s).resolve() == at or at in Path(s).resolve().parents for s in sources):
        raise ValueError("the scratch folder holds a source")
    if at.exists() and any(at.iterdir()) and not (at / OWNER_MARK).exists():
        raise ValueError("the scratch folder is in use and not ours")
    at.mkdir(parents=True, exist_ok=True)
    (at / OWNER_MARK).touch()
    for name, u in units.items():
        u.df.write.mode("overwrite").parquet(str(at / f"{name}.parquet"))


def read_catalog(path: str) -> list[dict]:
    """A catalog's entries: a JSON list, or an object with sources; relative files are beside the catalog."""
    found = json.loads(Path(path).read_text())
    entries = found.get("sources", []) if isinstance(found, dict) else found
    base = Path(path).parent
    fix = lambda p: p if Path(p).is_absolute() or "://" in p else str(base / p)
    return [e | {"data_file": fix(e["data_file"]), "extra_sources": [fix(p) for p in e.get("extra_sources", [])]} for e in entries]


def parse_mix(text: str) -> dict[str, float]:
    """Weights from "group=2,other=1"."""
    return {k.strip(): float(v) for k, v in (p.split("=") for p in text.split(",") if "=" in p)}


def choose_sources(entries: list[dict], mix: dict[str, float], total: int, seed: int) -> list[dict]:
    """Entries of each group by its share of the total, shuffled by seed."""
    rng, weight, out = random.Random(seed), sum(mix.values()) or 1, []
    for group, w in sorted(mix.items()):
        own = [e for e in entries if e.get("source_group") == group]
        rng.shuffle(own)
        out += own[: round(total * w / weight)]
    rng.shuffle(out)
    return out


def read_file(path: str, folder: str, most: int = 100_000) -> str:
    """A text file within the working folder, cut at `most` bytes."""
    at = (Path(folder) / path).resolve()
    if Path(folder).resolve() not in (at, *at.parents):
        raise PermissionError("outside the working folder")
    data = at.read_bytes()
    return data[:most].decode("utf-8", "replace") + ("\n... [truncated]" if len(data) > most else "")


def list_directory(path: str) -> list[str]:
    return sorted(p.name for p in Path(path).iterdir())


def write_file(path: str, text: str, folder: str, append: bool = False) -> int:
    at = (Path(folder) / path).resolve()
    if Path(folder).resolve() not in at.parents:
        raise PermissionError("outside the working folder")
    at.parent.mkdir(parents=True, exist_ok=True)
    with at.open("a" if append else "w") as f:
        return f.write(text)
