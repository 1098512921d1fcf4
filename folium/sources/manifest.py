"""Inputs of a consolidation run, found in folders.

The newest cleaning run, the newest duplicate diagnosis, the newest territorial base and the
newest homologated base are chosen by the time of their newest file; tables in them are found
by name, whatever their format.  Only paths and times are listed, one small aggregate a folder.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.sources import snapshots

SUFFIXES = (".csv", ".parquet", "")


@dataclass(frozen=True)
class Layout:
    """Where the inputs lie under the root, and what they are called."""

    cleaning: tuple[str, str] = ("limpieza", "ejecucion_")
    deduplication: tuple[str, str] = ("deduplicacion", "ejecucion_")
    territory: tuple[str, str] = ("territorio", "BD_APP_TERRITORIAL_")
    previous: tuple[str, str] = ("tecnicas", "BD_APP_FINAL_")
    technical: str = "tecnicas"
    records: str = "DATOS_HOMOLOGADOS"
    proposed: str = "PUBLICACIONES_PROPUESTAS"
    #: Batches of repository requests, in the order in which they are applied.
    requests: tuple[str, ...] = ("repositorios_reclasificados_solicitados", "repositorios_reclasificados_evaluacion")
    rules: tuple[str, ...] = tuple(fv.REPOSITORY_REQUEST_RULES)
    reviewed_types: str = "clasificacion_tipos_publicacion_auditada"


@dataclass(frozen=True)
class Manifest:
    """The paths that a run reads."""

    records: str
    proposed: str
    tables: dict[str, str]
    #: (path, rule) in order.
    requests: list[tuple[str, str]]
    reviewed_types: str | None
    #: The chosen folder of each kind, by the name it has in the run's summary.
    folders: dict[str, str]


def tables_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name -> path of the tables that lie directly in a folder.

    A table is a file or a folder of data files, called by its name with or without a suffix.
    """
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    child = F.regexp_extract("path", rf"^(.*/\Q{base}\E/([^/]+))", 1)
    files = snapshots.list_files(spark, folder, recursive=True).filter(~F.col("name").startswith("_"))
    found = {}
    for row in files.select(child.alias("path")).filter("path <> ''").distinct().collect():
        name = row["path"].rsplit("/", 1)[-1]
        for suffix in SUFFIXES:
            if name.endswith(suffix):
                found[name.removesuffix(suffix)] = row["path"]
                break
    return found


def _need(found: dict[str, str], names: Iterable[str], folder: str) -> dict[str, str]:
    missing = [n for n in names if n not in found]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(sorted(missing))}")
    return {n: found[n] for n in names}


def resolve(spark: SparkSession, root: str, layout: Layout = Layout()) -> Manifest:
    """Choose the inputs under ``root``; fails when a folder or a table that must be there is missing."""
    newest = lambda kind: snapshots.latest_directory(spark, f"{root.rstrip('/')}/{kind[0]}", kind[1])
    cleaning, diagnosis = newest(layout.cleaning), newest(layout.deduplication)
    territory, previous = newest(layout.territory), newest(layout.previous)
    technical = f"{root.rstrip('/')}/{layout.technical}"

    tables = _need(tables_in(spark, cleaning), [layout.records], cleaning)
    wanted = [c.T_RECORD_MAP, c.T_REVIEWED, layout.proposed, c.T_ID_REGISTRY, c.T_ID_MERGES]
    tables |= _need(tables_in(spark, diagnosis), wanted, diagnosis)
    tables |= _need(tables_in(spark, territory), [c.T_TERRITORY, c.T_MAP], territory)
    bridges = tables_in(spark, previous)
    tables |= {name: bridges[name] for name in c.DIMENSIONS if name in bridges}
    extra = tables_in(spark, technical)
    requests = _need(extra, layout.requests, technical)
    return Manifest(
        records=layout.records,
        proposed=layout.proposed,
        tables=tables,
        requests=[(requests[name], rule) for name, rule in zip(layout.requests, layout.rules, strict=True)],
        reviewed_types=extra.get(layout.reviewed_types),
        folders={
            "base_homologada": cleaning,
            "diagnostico_deduplicacion": diagnosis,
            "base_territorial": territory,
            "base_anterior": previous,
        },
    )
