"""Consolidation of source records into publications, bridges and audits."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.functions import text as t
from folium.functions.rules import bind, class_lookup
from folium.operators.bridges import as_is, bridge_from_records, remap_bridge
from folium.operators.checks import (
    Keyed,
    join_covering,
    join_many_to_one,
    join_one_to_one,
    plain,
    raise_when,
    require_columns,
    store_keyed,
    unique_by,
)
from folium.operators.classify import (
    classify_institutions,
    classify_repositories,
    institution_class,
)
from folium.operators.groups import SLICE_ROWS, group_ordinal, joined_first_seen, keep_first
from folium.operators.profile import union_all
from folium.operators.summaries import indicator_rows
from folium.operators.territory import consolidate_territory
from folium.session import stored
from folium.sources.manifest import Layout, Manifest, resolve
from folium.sources.tables import (
    append_trace,
    as_text,
    committed,
    new_timestamp,
    read_table,
    snapshot_path,
    with_row_ordinal,
    write_snapshot,
)

_FRONT = [c.PUB, c.REPRESENTATIVE, c.GROUP_SIZE, c.GROUP_RULES, c.STATE]


def _all(df: DataFrame) -> list[Column]:
    return [F.col(f"`{x}`") for x in df.columns]


def clean_database_names(records: DataFrame) -> DataFrame:
    return records.withColumn(c.DATABASE, t.database_name(F.col(c.DATABASE)))


# --------------------------------------------------------------------------
# Publications
# --------------------------------------------------------------------------
def build_publications(
    records: DataFrame | Keyed, record_map: DataFrame | Keyed, order: str = c.ORD
) -> DataFrame:
    """One row per publication: the representative record plus consolidated databases.

    The map must list every record exactly once.  That is checked inside the join
    that brings records and map together: each of them is scanned once for it, and dealt
    once by record.  Groups and details are read and dealt on their own.
    """
    mapped = join_covering(
        records.select(c.RECORD, F.col(c.DATABASE), order),
        record_map.select(c.RECORD, c.PUB),
        [c.RECORD],
        "the record map does not cover the records",
    )
    databases = joined_first_seen(mapped, [c.PUB], t.unicode_trim(F.col(c.DATABASE)), order, c.DATABASE)

    rows, groups = plain(records), plain(record_map)
    order_of = [F.col(order)] if order in groups.columns else [F.col(c.RECORD)]
    groups = keep_first(groups, [c.PUB], order_of).select(*_FRONT)
    details = rows.drop(c.DATABASE, order).withColumn(c.REPRESENTATIVE, F.col(c.RECORD))
    if isinstance(records, Keyed):  # the representative is the record, whose key was checked
        details = Keyed(details, (c.REPRESENTATIVE,))
    publications = join_one_to_one(
        groups, details, [c.REPRESENTATIVE], "left", "a record represents several publications"
    )
    # Every group of the map has at least one record, so the databases join is total.
    publications = publications.join(databases, c.PUB, "left").withColumn(
        c.DATABASE, F.coalesce(c.DATABASE, F.lit(""))
    )
    kind = F.col(c.TYPE_NORM)
    return publications.withColumns(
        {
            c.UNIQUE_FLAG: F.lit("SI"),
            c.PUBLIC_TYPE: t.recode(kind, {fv.CONFERENCE_ARTICLE: fv.ARTICLE}),
            c.PUBLIC_SUBTYPE: t.lookup(
                kind,
                {fv.ARTICLE: fv.SCIENTIFIC_ARTICLE, fv.CONFERENCE_ARTICLE: fv.EVENT_PUBLICATION},
            ),
        }
    ).select(*_FRONT, *[F.col(f"`{x}`") for x in _tail(publications)])


def _tail(publications: DataFrame) -> list[str]:
    rest = [x for x in publications.columns if x not in _FRONT]
    return [*rest, c.UNIQUE_FLAG, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE]


def apply_type_decisions(publications: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Overwrite type and subtype where a reviewed decision names a type.

    A decision with a type but no subtype clears the subtype.
    """
    if decisions is None:
        return publications
    required = [c.PUB, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE]
    require_columns(decisions, required, "reviewed types")
    extra = [c.POSTGRAD_DETAIL] if c.POSTGRAD_DETAIL in decisions.columns else []
    result = join_many_to_one(
        publications.drop(*extra),
        decisions.select(*required, *extra),
        [c.PUB],
        "left",
        "reviewed types repeat a publication",
    )
    decided = F.col(c.PROPOSED_TYPE).isNotNull()
    return result.withColumns(
        {
            c.PUBLIC_TYPE: F.when(decided, F.col(c.PROPOSED_TYPE)).otherwise(F.col(c.PUBLIC_TYPE)),
            c.PUBLIC_SUBTYPE: F.when(decided, F.col(c.PROPOSED_SUBTYPE)).otherwise(F.col(c.PUBLIC_SUBTYPE)),
        }
    ).drop(c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE)


# --------------------------------------------------------------------------
# Academic fields
# --------------------------------------------------------------------------
_RANKS = {level: i for i, (level, *_rest) in enumerate(fv.LEVEL_PRECEDENCE)}


def _level_rank(value: Column) -> Column:
    rank = F.lit(len(_RANKS))
    for level, i in _RANKS.items():
        rank = F.when(value == level, i).otherwise(rank)
    return rank


def _from_rank(rank: Column, position: int) -> Column:
    labels = [row[position] for row in fv.LEVEL_PRECEDENCE] + [fv.OTHERS]
    return F.get(F.array(*[F.lit(x) for x in labels]), rank)


def academic_levels(rows: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Per group: distinct levels, the most specific one and whether families clash.

    Levels are made distinct by a partial aggregate first, so the per-group list
    holds the few level names and never the group's rows.
    """
    level = t.unicode_trim(value)
    usable = (level != "") & (level != fv.NOT_APPLICABLE)
    family = {row[0]: row[3] for row in fv.LEVEL_PRECEDENCE}
    distinct = rows.select(*group, F.when(usable, level).alias("_level")).distinct()
    in_family = lambda name: F.coalesce(
        F.bool_or(F.col("_level").isin([k for k, v in family.items() if v == name])), F.lit(False)
    )
    return (
        distinct.groupBy(*group)
        .agg(
            F.min(F.when(F.col("_level").isNotNull(), _level_rank(F.col("_level")))).alias("_rank"),
            F.array_sort(F.collect_list("_level")).alias("_levels"),
            (in_family("Pregrado") & in_family("Posgrado")).alias("_clash"),
        )
        .withColumn("_rank", F.coalesce("_rank", F.lit(len(_RANKS))))
        .withColumns({c.GRADE: _from_rank(F.col("_rank"), 1), c.LEVEL: _from_rank(F.col("_rank"), 2)})
    )


def academic_fields(levels: DataFrame, group: list[str]) -> DataFrame:
    return levels.select(*group, c.GRADE, c.LEVEL)


def academic_conflicts(levels: DataFrame, group: list[str]) -> DataFrame:
    """Groups with more than one level, as an audit table."""
    return levels.filter(F.size("_levels") > 1).select(
        *group,
        F.array_join("_levels", " | ").alias("VALORES_ORIGEN"),
        c.GRADE,
        c.LEVEL,
        F.when(F.col("_clash"), fv.CONFLICT_CONTRADICTORY)
        .otherwise(fv.CONFLICT_MULTIPLE)
        .alias("TIPO_CONFLICTO"),
        F.lit(fv.CONFLICT_RULE).alias("REGLA"),
    )


def derive_academic_fields(
    records: DataFrame | Keyed, record_map: DataFrame | Keyed
) -> tuple[DataFrame, DataFrame]:
    """Grade and level of every publication with a thesis record, and the conflicts."""
    theses = records.filter(F.col(c.TYPE_NORM) == fv.THESIS).select(c.RECORD, F.col(c.RAW_LEVEL))
    work = join_one_to_one(
        theses, record_map.select(c.RECORD, c.PUB), [c.RECORD], "inner", "a record repeats"
    )
    levels = academic_levels(work, [c.PUB], F.col(c.RAW_LEVEL))
    return academic_fields(levels, [c.PUB]), academic_conflicts(levels, [c.PUB])


# --------------------------------------------------------------------------
# Misplaced journals
# --------------------------------------------------------------------------
def migrate_misplaced_journals(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Move journals found in the institution column to the journal column.

    Works row by row inside the scan stage; the audit is the same projection
    filtered to the rows that changed.
    """
    if c.INSTITUTION not in records.columns or c.JOURNAL not in records.columns:
        return records, None
    institution = t.unicode_trim(F.coalesce(F.col(c.INSTITUTION), F.lit("")))
    keyed = bind(records, {"_institution": institution, "_key": t.fold_upper(institution)})
    marked = bind(
        keyed,
        {
            "_misplaced": institution_class("_key")[c.INST_CLASS] == fv.INST_JOURNAL,
            "_no_journal": t.is_empty_category(F.col(c.JOURNAL)),
        },
    )
    moved = F.col("_misplaced") & F.col("_no_journal")
    final_journal = F.when(moved, F.col("_institution")).otherwise(F.col(c.JOURNAL))
    final_institution = F.when(
        F.col("_misplaced"),
        t.lookup(F.col("_institution"), fv.MISPLACED_JOURNALS, F.lit(fv.OTHERS)),
    ).otherwise(F.col(c.INSTITUTION))
    result = marked.withColumns({c.JOURNAL: final_journal, c.INSTITUTION: final_institution}).select(
        *_all(records)
    )
    master = F.col(c.MASTER_KEY) if c.MASTER_KEY in records.columns else F.lit(None).cast("string")
    audit = marked.filter("_misplaced").select(
        c.RECORD,
        master.alias(c.MASTER_KEY),
        F.col("_institution").alias("INSTITUCION_ORIGINAL"),
        F.col(c.JOURNAL).alias("REVISTA_ORIGINAL"),
        final_journal.alias("REVISTA_FINAL"),
        final_institution.alias("INSTITUCION_FINAL"),
        F.when(F.col("_no_journal"), fv.JOURNAL_MOVED).otherwise(fv.JOURNAL_KEPT).alias("ACCION_REVISTA"),
        F.lit(fv.JOURNAL_RULE).alias("REGLA"),
    )
    return result, audit


# --------------------------------------------------------------------------
# Requested repository updates
# --------------------------------------------------------------------------
_REQUEST = [c.PUB, c.REQUEST_OLD, c.REQUEST_NEW, c.REQUEST_CLASS]


def checked_requests(requests: DataFrame) -> DataFrame:
    """Trimmed requests; the job fails on repeated ids, ``otros`` or a class outside the list."""
    return unique_by(_allowed_requests(requests), [c.PUB], "repository requests repeat a publication")


def _allowed_requests(requests: DataFrame) -> DataFrame:
    require_columns(requests, _REQUEST, "repository requests")
    # Ids of another type than text have nothing to trim, and a cast would spoil the join key.
    texts = [x for x in _REQUEST if dict(requests.dtypes)[x] == "string"]
    trimmed = requests.withColumns({x: t.unicode_trim(F.col(x)) for x in texts})
    trimmed = raise_when(
        trimmed,
        F.coalesce(F.lower(F.col(c.REQUEST_OLD)) == fv.OTHERS_LOWER, F.lit(False)),
        "the exact value Otros cannot be reclassified",
    )
    bad_class = ~F.coalesce(F.col(c.REQUEST_CLASS).isin(list(fv.REQUESTED_REPOSITORY)), F.lit(False))
    return raise_when(trimmed, bad_class, "repository requests hold a class that is not allowed")


#: What a relation carries through the batches: field and column of the bridge.
_STATE = {
    "name": c.CATEGORY,
    "technical": c.REPO_CLASS,
    "university": c.REPO_IS_UNIVERSITY,
    "public": c.REPO_PUBLIC_CLASS,
    "rule": c.REPO_PUBLIC_RULE,
    "review": c.REPO_PUBLIC_REVIEW,
}


def _folded_requests(batches: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """One row a publication with its request of each batch, ``_b0``, ``_b1``, ..., null where it has none."""
    every = None
    for i, (requests, rule, source) in enumerate(batches):
        part = _allowed_requests(requests)
        whole = F.struct(*_all(part)).alias(f"_r{i}")
        technical = class_lookup(
            F.col(c.REQUEST_CLASS), fv.REQUESTED_REPOSITORY, (c.REPO_CLASS, c.REPO_IS_UNIVERSITY)
        )
        wanted = F.struct(
            F.col(c.REQUEST_OLD).alias("old"),
            F.col(c.REQUEST_NEW).alias("name"),
            technical[c.REPO_CLASS].alias("technical"),
            technical[c.REPO_IS_UNIVERSITY].alias("university"),
            F.col(c.REQUEST_CLASS).alias("public"),
            F.lit(rule).alias("rule"),
            F.lit("No").alias("review"),
        ).alias(f"_b{i}")
        part = part.select(c.PUB, whole, wanted)
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    numbers = range(len(batches))
    folded = every.groupBy(c.PUB).agg(
        *[F.first(f"_r{i}", ignorenulls=True).alias(f"_r{i}") for i in numbers],
        *[F.first(f"_b{i}", ignorenulls=True).alias(f"_b{i}") for i in numbers],
        *[F.count(f"_b{i}").alias(f"_n{i}") for i in numbers],
    )
    twice = F.greatest(F.lit(0), *[F.col(f"_n{i}") for i in numbers]) > 1
    return raise_when(folded, twice, "repository requests repeat a publication").drop(*[f"_n{i}" for i in numbers])


def _followed(relations: DataFrame, batches: int) -> DataFrame:
    """Relations beside the requests of their publication, followed through all batches in order.

    Adds, for each batch, whether its request meets the relation (``_hit<i>``) and the state
    of the relation before it (``_s<i>``); the last state is ``_s<batches>``.
    """
    texts = lambda column: F.col(f"`{column}`").cast("string")
    out = bind(relations, {"_s0": F.struct(*[texts(column).alias(x) for x, column in _STATE.items()])})
    for i in range(batches):
        now, wanted = F.col(f"_s{i}"), F.col(f"_b{i}")
        met = F.coalesce(t.unicode_trim(now["name"]) == wanted["old"], F.lit(False))
        out = bind(out, {f"_hit{i}": met})
        out = raise_when(
            out,
            ~F.col(f"_hit{i}") & F.coalesce(now["name"] == wanted["name"], F.lit(False)),
            "the update repeats a publication-repository relation",
        )
        after = F.struct(*[F.when(F.col(f"_hit{i}"), wanted[x]).otherwise(now[x]).alias(x) for x in _STATE])
        out = bind(out, {f"_s{i + 1}": after})
    return out


def _matched_requests(bridge: DataFrame, folded: DataFrame, batches: int) -> DataFrame:
    """The folded requests with the state that each met (``_s<i>``); each must meet one relation."""
    followed = _followed(folded.join(bridge.select(c.PUB, *_STATE.values()), c.PUB, "left"), batches)
    hit = lambda i: F.col(f"_hit{i}")
    found = followed.groupBy(c.PUB).agg(
        *[F.first(f"_{kind}{i}").alias(f"_{kind}{i}") for i in range(batches) for kind in "rb"],
        *[F.count_if(hit(i)).alias(f"_n{i}") for i in range(batches)],
        *[F.first(F.when(hit(i), F.col(f"_s{i}")), ignorenulls=True).alias(f"_s{i}") for i in range(batches)],
    )
    for i in range(batches):
        told = F.concat(
            F.lit("expected one match for "),
            F.col(c.PUB).cast("string"),
            F.lit(" / "),
            F.coalesce(F.col(f"_b{i}")["old"], F.lit("")),
            F.lit(", found "),
            F.col(f"_n{i}").cast("string"),
        )
        found = raise_when(found, F.col(f"_b{i}").isNotNull() & (F.col(f"_n{i}") != 1), told)
    return found


def _request_audit(matched: DataFrame, batches: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """A row for each request: itself, what it replaced and what it made."""
    rows = []
    for i, (requests, rule, source) in enumerate(batches):
        request, wanted, before = (F.col(f"_{kind}{i}") for kind in "rbs")
        rows.append(
            F.when(
                wanted.isNotNull(),
                F.struct(
                    F.lit(i).alias("_batch"),
                    *[F.col(f"_r{j}") for j in range(len(batches))],
                    before["technical"].alias("CLASE_TECNICA_ANTERIOR"),
                    before["public"].alias("CLASE_PUBLICA_ANTERIOR"),
                    before["review"].alias("REQUIERE_REVISION_ANTERIOR"),
                    wanted["technical"].alias("CLASE_TECNICA_FINAL"),
                    wanted["public"].alias("CLASE_PUBLICA_FINAL"),
                    F.lit(rule).alias(c.RULE),
                    F.lit(source).alias("ARCHIVO_DECISION"),
                ),
            )
        )
    audit = matched.select(F.inline(F.array_compact(F.array(*rows))))
    names = list(dict.fromkeys(x for requests, _, _ in batches for x in requests.columns))
    own = []
    for name in names:
        value = F.lit(None)
        for i, (requests, _, _) in enumerate(batches):
            if name in requests.columns:
                value = F.when(F.col("_batch") == i, F.col(f"_r{i}")[name]).otherwise(value)
        own.append(value.alias(name))
    ends = [x for x in audit.columns if x != "_batch" and not x.startswith("_r")]
    return audit.select(*own, *ends)


def apply_request_log(
    bridge: DataFrame,
    batches: list[tuple[DataFrame, str, str]],
    order: str = c.ORD,
    width: int = SLICE_ROWS,
    store: Callable[[DataFrame], DataFrame] = as_is,
) -> tuple[DataFrame, DataFrame]:
    """Apply batches of ``(requests, rule, source)`` in order; the bridge and the audit of what was replaced.

    The batches are folded into one row a publication, so however many there are the bridge
    meets them once: a relation is followed through all of them row by row, and a later
    batch sees the names an earlier one gave.  Each request must meet exactly one relation,
    and no new name may repeat another relation of its publication.  Requests are matched
    against the relations of their own publications alone; ``store`` may write the matched ones
    down, which both results read.  Rows are neither added nor moved, so category numbers stay
    valid and are only computed for bridges that have none.
    """
    matched = store(_matched_requests(bridge, _folded_requests(batches), len(batches)))
    wanted = matched.select(c.PUB, *[f"_b{i}" for i in range(len(batches))])
    joined = _followed(bridge.join(wanted, c.PUB, "left"), len(batches))
    last, kinds = F.col(f"_s{len(batches)}"), dict(bridge.dtypes)
    touched = F.greatest(F.lit(False), *[F.col(f"_hit{i}") for i in range(len(batches))])
    changes = {
        column: F.when(touched, last[x].cast(kinds[column])).otherwise(F.col(f"`{column}`"))
        for x, column in _STATE.items()
    }
    if c.REPOSITORY in bridge.columns:
        changes[c.REPOSITORY] = F.when(touched, last["name"]).otherwise(F.col(f"`{c.REPOSITORY}`"))
    updated = joined.withColumns(changes).select(*_all(bridge))
    if c.CATEGORY_ORDER not in updated.columns:
        updated = group_ordinal(updated, [c.PUB], order, c.CATEGORY_ORDER, width)
    return updated, _request_audit(matched, batches)


def apply_repository_requests(
    bridge: DataFrame,
    requests: DataFrame,
    rule: str,
    source: str = "",
    order: str = c.ORD,
    width: int = SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """One batch of :func:`apply_request_log`."""
    return apply_request_log(bridge, [(requests, rule, source)], order, width)


# --------------------------------------------------------------------------
# The whole run
# --------------------------------------------------------------------------
@dataclass
class ConsolidationInputs:
    """Tables of a run.  ``records``, bridges and territory carry the row ordinal."""

    records: DataFrame
    record_map: DataFrame
    proposed_ids: DataFrame
    reviewed: DataFrame
    id_registry: DataFrame
    id_merges: DataFrame
    bridges: Mapping[str, DataFrame]
    territory: DataFrame
    departments: DataFrame
    requests: list[tuple[DataFrame, str, str]] = field(default_factory=list)
    type_decisions: DataFrame | None = None
    other_territory: Mapping[str, DataFrame] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=dict)


def data_contract(spark: SparkSession, bridges: list[str], territory: list[str]) -> DataFrame:
    """One row per table: name, purpose and key."""
    rows = list(fv.CONTRACT_ROWS)
    rows += [(name, *fv.CONTRACT_BRIDGE) for name in bridges]
    rows += [
        (
            name,
            fv.CONTRACT_TERRITORY,
            f"{c.PUB} + {c.DEP_KEY}" if name == c.T_TERRITORY else c.DEP_KEY,
        )
        for name in territory
    ]
    return spark.createDataFrame(rows, "hoja string, proposito string, clave string")


def text_rows(spark: SparkSession, rows: list[tuple[str, str]], name="indicador", value="valor") -> DataFrame:
    return spark.createDataFrame(rows, f"`{name}` string, `{value}` string")


def run_summary(inputs: ConsolidationInputs, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Indicators of a run: one single-row aggregate per table, as rows of text.

    Give it the written tables, so that counting does not redo the run.
    """
    spark = inputs.records.sparkSession
    names = ["base_homologada", "diagnostico_deduplicacion", "base_territorial"]
    head = [("fecha_adaptacion", datetime.now().isoformat(timespec="seconds"))]
    head += [(name, str(inputs.labels.get(name, ""))) for name in names]

    def rows_of(df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            return text_rows(spark, [(name, "0")])
        return indicator_rows(df.agg(F.count(F.lit(1)).alias(name)))

    def classes(table: str, column: str, name: str) -> DataFrame:
        if table not in tables:
            return text_rows(spark, [(name, "0")])
        return indicator_rows(tables[table].agg(F.count_distinct(column).alias(name)))

    publications = tables[c.T_PUBLICATIONS]
    redundant = tables[c.T_RECORD_MAP].agg(
        (F.count(F.lit(1)) - F.count_distinct(c.PUB)).alias("registros_redundantes")
    )
    conference = publications.agg(
        F.count_if(F.col(c.PUBLIC_SUBTYPE) == fv.CONFERENCE_ARTICLE).alias("articulos_de_conferencia")
    )
    parts = [
        text_rows(spark, head),
        rows_of(tables[c.T_RECORDS], "registros_origen"),
        rows_of(publications, "publicaciones_consolidadas"),
        indicator_rows(redundant),
        rows_of(tables[c.T_REVIEWED], "decisiones_revisadas"),
        indicator_rows(
            publications.agg(F.count_if(F.col(c.GRADE).isNotNull()).alias("tesis_con_campos_academicos"))
        ),
        rows_of(tables[c.T_ACADEMIC_AUDIT], "conflictos_academicos_auditados"),
        rows_of(tables.get(c.T_INSTITUTION_AUDIT), "migraciones_institucion_revista"),
        rows_of(tables.get(c.T_REPOSITORY_AUDIT), "repositorios_reclasificados_solicitados"),
        rows_of(tables[c.T_ID_REGISTRY], "claves_registro_maestro"),
        rows_of(tables[c.T_ID_MERGES], "fusiones_ids_historicos"),
        classes(c.DIM_REPOSITORIES, c.REPO_PUBLIC_CLASS, "clases_repositorio"),
        classes(c.DIM_INSTITUTIONS, c.INST_PUBLIC_CLASS, "clases_institucion"),
        indicator_rows(conference),
    ]
    return union_all([p.select("indicador", F.col("valor").cast("string").alias("valor")) for p in parts])


def consolidate(
    inputs: ConsolidationInputs, store: Callable[[DataFrame], DataFrame] = as_is
) -> dict[str, DataFrame]:
    """Every table of the consolidated catalogue.

    Lazy unless ``store`` writes down the frames that several tables read: the
    cleaned records and the record map, whose keys are checked in that write and by no
    join after it, and the kept rows of each bridge and of the territory.

    Order of work: clean records, move misplaced journals, remap and classify the
    bridges, apply requests, build publications with ids, academic fields and
    reviewed types, consolidate the territory, summarise.
    """
    records = clean_database_names(inputs.records)
    records, institution_audit = migrate_misplaced_journals(records)
    records = store_keyed(records, [c.RECORD], "a record repeats", store)
    record_map = store_keyed(inputs.record_map, [c.RECORD], "the record map repeats a record", store)

    bridges = {
        name: remap_bridge(bridge, record_map, store=store)
        for name, bridge in inputs.bridges.items()
        if name in c.DIMENSIONS
    }
    audits: list[DataFrame] = []
    if c.DIM_REPOSITORIES in bridges:
        repositories = classify_repositories(bridges[c.DIM_REPOSITORIES])
        if inputs.requests:
            repositories, audit = apply_request_log(repositories, inputs.requests, store=store)
            audits.append(audit)
        bridges[c.DIM_REPOSITORIES] = repositories
    bridges[c.DIM_INSTITUTIONS] = classify_institutions(
        bridge_from_records(records, record_map, c.INSTITUTION, store=store)
    )
    bridges[c.DIM_DATABASES] = bridge_from_records(records, record_map, c.DATABASE, store=store)

    fields, conflicts = derive_academic_fields(records, record_map)
    publications = build_publications(records, record_map)
    ids = inputs.proposed_ids.select(c.PUB, c.FINGERPRINT, c.FINGERPRINT_METHOD)
    publications = join_many_to_one(
        publications.drop(c.FINGERPRINT, c.FINGERPRINT_METHOD), ids, [c.PUB], "left", "proposed ids repeat"
    )
    publications = publications.join(fields, c.PUB, "left")
    publications = apply_type_decisions(publications, inputs.type_decisions)

    territory = {
        **inputs.other_territory,
        **consolidate_territory(inputs.territory, inputs.departments, record_map, store=store),
    }
    tables: dict[str, DataFrame] = {
        c.T_PUBLICATIONS: publications,
        c.T_RECORDS: records.table,
        c.T_RECORD_MAP: record_map.table,
        c.T_REVIEWED: inputs.reviewed,
        c.T_ACADEMIC_AUDIT: conflicts,
        c.T_ID_REGISTRY: inputs.id_registry,
        c.T_ID_MERGES: inputs.id_merges,
    }
    if institution_audit is not None:
        tables[c.T_INSTITUTION_AUDIT] = institution_audit
    if audits:
        tables[c.T_REPOSITORY_AUDIT] = union_all(audits)
    tables.update(bridges)
    tables.update(territory)
    tables[c.T_CONTRACT] = data_contract(records.table.sparkSession, list(bridges), list(territory))
    return tables


def run_trace(snapshot: str, summary: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Trace of a run: its snapshot, the paths it read and the numbers of its summary."""
    rows = [("instantanea", snapshot), *sorted((f"fuente_{k}", str(v)) for k, v in labels.items())]
    return text_rows(summary.sparkSession, rows).unionByName(summary)


def run_consolidation(inputs: ConsolidationInputs, root: str, timestamp: str | None = None) -> str:
    """Write a consolidated snapshot and return its folder.

    Shared intermediates are stored, tables are written, and the summary is counted
    over what was written: a lost executor repeats one write, not the run.  The run's trace
    goes to ``root`` under the snapshot's timestamp, just before the summary that commits the
    snapshot.  A run repeated with a timestamp that is complete writes nothing; one that broke
    off is written anew.
    """
    timestamp = timestamp or new_timestamp()
    snapshot = snapshot_path(root, timestamp)
    spark = inputs.records.sparkSession
    if committed(spark, f"{snapshot}/{c.T_SUMMARY}"):
        return snapshot
    tables = consolidate(inputs, stored)
    write_snapshot(tables, root, timestamp, mode="overwrite")
    written = {name: read_table(spark, f"{snapshot}/{name}") for name in tables}
    summary = stored(run_summary(inputs, written))
    append_trace(run_trace(snapshot, summary, inputs.labels), f"{root.rstrip('/')}/{c.T_RUNS}", timestamp)
    write_snapshot({c.T_SUMMARY: summary}, root, timestamp, mode="overwrite")
    return snapshot


def run_from_folders(
    spark: SparkSession, sources: str, root: str, timestamp: str | None = None, layout: Layout = Layout()
) -> str:
    """The whole run from folders: newest inputs in, snapshot and trace out."""
    return run_consolidation(load_inputs(spark, resolve(spark, sources, layout)), root, timestamp)


def load_inputs(spark: SparkSession, manifest: Manifest) -> ConsolidationInputs:
    """The tables of a manifest; records, bridges and territory get their row ordinal."""
    path = manifest.tables
    plain_table = lambda name: as_text(read_table(spark, path[name]))
    ordered = lambda name: with_row_ordinal(plain_table(name))
    return ConsolidationInputs(
        records=ordered(manifest.records),
        record_map=plain_table(c.T_RECORD_MAP),
        proposed_ids=plain_table(manifest.proposed),
        reviewed=plain_table(c.T_REVIEWED),
        id_registry=plain_table(c.T_ID_REGISTRY),
        id_merges=plain_table(c.T_ID_MERGES),
        bridges={name: ordered(name) for name in c.DIMENSIONS if name in path},
        territory=ordered(c.T_TERRITORY),
        departments=plain_table(c.T_MAP),
        requests=[(read_table(spark, at), rule, at.rsplit("/", 1)[-1]) for at, rule in manifest.requests],
        type_decisions=read_table(spark, manifest.reviewed_types) if manifest.reviewed_types else None,
        labels=manifest.folders,
    )
