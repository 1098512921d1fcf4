"""Classifiers of institutions, repositories and document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.functions import text as t
from folium.functions.rules import (
    KeyRule,
    bind,
    class_lookup,
    first_match,
    first_pattern,
    regex,
)

INSTITUTION_RULES = [
    KeyRule((fv.UNCLASSIFIED, "Indeterminado"), exact=("", "OTROS")),
    KeyRule((fv.INST_JOURNAL, "No"), markers=tuple(fv.JOURNAL_MARKERS)),
    KeyRule((fv.INST_SOCIETY, "No"), markers=tuple(fv.SOCIETY_MARKERS)),
    KeyRule((fv.INST_STATE, "No"), exact=tuple(fv.PUBLIC_ENTITIES), prefixes=("MINISTERIO ",)),
    KeyRule((fv.INST_CENTRE, "No"), exact=tuple(fv.RESEARCH_CENTRES), prefixes=("CENTRO ",)),
    KeyRule((fv.INST_PRIVATE_UNIVERSITY, "Si"), exact=tuple(fv.PRIVATE_UNIVERSITIES)),
    KeyRule(
        (fv.INST_PUBLIC_UNIVERSITY, "Si"),
        exact=tuple(fv.PUBLIC_UNIVERSITY_ALIASES),
        prefixes=("UNIVERSIDAD NACIONAL ",),
    ),
    KeyRule(
        (fv.INST_FOREIGN_UNIVERSITY, "Si"),
        exact=tuple(fv.FOREIGN_UNIVERSITIES),
        markers=tuple(fv.FOREIGN_UNIVERSITY_MARKERS),
    ),
    KeyRule(
        (fv.INST_PRIVATE_UNIVERSITY, "Si"),
        prefixes=("UNIVERSIDAD ", "PONTIFICIA UNIVERSIDAD "),
    ),
    KeyRule((fv.INST_CENTRE, "No"), prefixes=("INSTITUTO ",)),
]

REPOSITORY_RULES = [
    KeyRule((fv.UNCLASSIFIED, "Indeterminado"), exact=("", *fv.REPOSITORY_BLANKS)),
    KeyRule((fv.REPO_SEARCH, "No"), exact=tuple(fv.SEARCH_ENGINES)),
    KeyRule((fv.REPO_NETWORK, "No"), exact=tuple(fv.ACADEMIC_NETWORKS)),
    KeyRule((fv.REPO_AGGREGATOR, "No"), exact=tuple(fv.NATIONAL_AGGREGATORS)),
    KeyRule((fv.REPO_INDEX, "No"), exact=tuple(fv.BIBLIOGRAPHIC_INDEXES)),
    KeyRule((fv.REPO_JOURNAL, "No"), exact=tuple(fv.JOURNAL_PORTALS), prefixes=("REVISTA ",)),
    KeyRule((fv.REPO_PUBLISHER, "No"), exact=tuple(fv.PUBLISHER_PLATFORMS)),
    KeyRule(
        (fv.REPO_ARCHIVE, "No"),
        exact=tuple(fv.LIBRARY_ARCHIVES),
        markers=tuple(fv.LIBRARY_MARKERS),
    ),
    KeyRule((fv.REPO_PUBLIC, "No"), exact=tuple(fv.PUBLIC_INSTITUTION_REPOSITORIES)),
    KeyRule(
        (fv.REPO_UNIVERSITY, "Si"),
        exact=(*fv.UNIVERSITY_REPOSITORIES, *fv.UNIVERSITY_ACRONYMS),
        prefixes=("REPOSITORIO U", "UNIVERSIDAD "),
    ),
]

_UNKNOWN = (fv.UNCLASSIFIED, "Indeterminado")


def institution_class(key: str) -> Column:
    """Struct ``(CLASE_INSTITUCION, ES_UNIVERSIDAD)`` of a folded key column."""
    return first_match(key, INSTITUTION_RULES, (c.INST_CLASS, c.INST_IS_UNIVERSITY), _UNKNOWN)


def public_institution_class(technical: Column) -> Column:
    """Struct ``(CLASE_INSTITUCION_PUBLICA, SUBCLASE_UNIVERSIDAD_PUBLICA)`` of a technical class."""
    names = (c.INST_PUBLIC_CLASS, c.INST_PUBLIC_SUBCLASS)
    return class_lookup(technical, fv.PUBLIC_INSTITUTION, names)


def repository_class(key: str) -> Column:
    """Struct ``(CLASE_REPOSITORIO, ES_REPOSITORIO_UNIVERSITARIO)`` of a folded key column."""
    return first_match(key, REPOSITORY_RULES, (c.REPO_CLASS, c.REPO_IS_UNIVERSITY), _UNKNOWN)


def public_repository_class(technical: Column) -> Column:
    """Struct of public class, rule id and review flag of a technical class."""
    names = (c.REPO_PUBLIC_CLASS, c.REPO_PUBLIC_RULE, c.REPO_PUBLIC_REVIEW)
    return class_lookup(technical, fv.PUBLIC_REPOSITORY, names)


def _classified(bridge: DataFrame, category: str, technical, public, class_name: str) -> DataFrame:
    keyed = bind(bridge, {"_key": t.fold_upper(F.col(category))})
    classed = bind(keyed, {"_class": technical("_key")})
    return classed.select(
        *[F.col(f"`{x}`") for x in bridge.columns],
        "_class.*",
        public(F.col("_class")[class_name]).alias("_public"),
    ).select(*[F.col(f"`{x}`") for x in bridge.columns], *_NAMES[class_name], "_public.*")


_NAMES = {
    c.REPO_CLASS: (c.REPO_CLASS, c.REPO_IS_UNIVERSITY),
    c.INST_CLASS: (c.INST_CLASS, c.INST_IS_UNIVERSITY),
}


def classify_repositories(bridge: DataFrame, category: str = c.CATEGORY) -> DataFrame:
    """Add the five repository columns to a bridge; stays in the scan stage."""
    return _classified(bridge, category, repository_class, public_repository_class, c.REPO_CLASS)


def classify_institutions(bridge: DataFrame, category: str = c.CATEGORY) -> DataFrame:
    """Add the four institution columns to a bridge; stays in the scan stage."""
    return _classified(bridge, category, institution_class, public_institution_class, c.INST_CLASS)


def with_default_repository_classes(bridge: DataFrame) -> DataFrame:
    """Fill the class columns of bridges that were never classified."""
    if c.REPO_CLASS not in bridge.columns:
        bridge = bridge.withColumns(
            {c.REPO_CLASS: F.lit(fv.UNCLASSIFIED), c.REPO_IS_UNIVERSITY: F.lit("Indeterminado")}
        )
    if c.REPO_PUBLIC_CLASS not in bridge.columns:
        bridge = bridge.withColumn(c.REPO_PUBLIC_CLASS, F.lit(fv.OTHERS))
    return bridge


def with_default_institution_classes(bridge: DataFrame) -> DataFrame:
    """Fill missing class columns; the public class follows from the technical one."""
    if c.INST_CLASS not in bridge.columns:
        bridge = bridge.withColumns(
            {c.INST_CLASS: F.lit(fv.UNCLASSIFIED), c.INST_IS_UNIVERSITY: F.lit("Indeterminado")}
        )
    if c.INST_PUBLIC_CLASS not in bridge.columns:
        public = public_institution_class(F.col(c.INST_CLASS))
        bridge = bridge.withColumns(
            {
                c.INST_PUBLIC_CLASS: public[c.INST_PUBLIC_CLASS],
                c.INST_PUBLIC_SUBCLASS: public[c.INST_PUBLIC_SUBCLASS],
            }
        )
    return bridge


# --------------------------------------------------------------------------
# Document types
# --------------------------------------------------------------------------
def binary_type(col: Column) -> Column:
    """``Tesis`` when the folded text mentions it, otherwise the article label."""
    return F.when(t.strip_marks_lower(col).contains("tesis"), F.lit(fv.THESIS)).otherwise(
        F.lit(fv.SCIENTIFIC_ARTICLE)
    )


def editorial_signals(present: dict[str, Column], address: Column) -> Column:
    """Array of editorial signals, each once, in order of precedence.

    ``present`` names the structured signals and tells whether each is there;
    ``address`` is the folded URL.
    """
    signals = [F.when(there, F.lit(name)) for name, there in present.items()]
    signals += [
        F.when(address.contains(fragment), F.lit(label))
        for fragment, label in fv.EDITORIAL_DOMAINS.items()
    ]
    return F.array_distinct(F.array_compact(F.array(*signals)))


# Column -> name of its folded value while proposals are computed.
_FOLDED = {
    c.RAW_TYPE: "_type",
    c.RAW_LEVEL: "_level",
    c.TITLE: "_title",
    c.REPOSITORY: "_repository",
    c.JOURNAL: "_journal",
    c.URL: "_url",
    c.DOI: "_doi",
    c.VOLUME: "_volume",
    c.ISSUE: "_issue",
}
_SIGNAL_COLUMNS = {"revista": "_journal", "doi": "_doi", "volumen": "_volume", "numero": "_issue"}
_CONTEXT_COLUMNS = ["_title", "_repository", "_journal", "_url"]


def with_folded(df: DataFrame) -> DataFrame:
    """Folded text of every column the type rules read, once per row; absent columns are blank."""

    def source(name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

    # One folding expression for all columns keeps the plan small.
    texts = F.array(*[source(name).cast("string") for name in _FOLDED])
    folded = bind(df, {"_folded": F.transform(texts, t.fold_lower)})
    columns = {alias: F.get(F.col("_folded"), F.lit(i)) for i, alias in enumerate(_FOLDED.values())}
    return folded.withColumns(columns).drop("_folded")


def folded_signals() -> Column:
    """Editorial signals over the folded columns of :func:`with_folded`."""
    present = {name: t.is_present_key(F.col(x)) for name, x in _SIGNAL_COLUMNS.items()}
    return editorial_signals(present, F.col("_url"))


def folded_context() -> Column:
    """Title, repository, journal and address joined, over the folded columns."""
    return t.joined_present_keys(*[F.col(x) for x in _CONTEXT_COLUMNS])


_PROPOSAL = [
    c.PROPOSED_TYPE,
    c.PROPOSED_SUBTYPE,
    c.CONFIDENCE,
    c.NEEDS_REVIEW,
    c.EVIDENCE,
    c.RULE,
]


def _proposal(kind, subtype, confidence, review, evidence, rule) -> Column:
    values = (kind, subtype, confidence, review, evidence, rule)
    return F.struct(
        *[
            (v if isinstance(v, Column) else F.lit(v)).alias(n)
            for n, v in zip(_PROPOSAL, values)
        ]
    )


def propose_types(df: DataFrame) -> DataFrame:
    """Add the six proposal columns of the document-type audit.

    Texts are folded once and patterns searched once per row; the rules are
    branches of one lazy ``CASE`` of structs over those values.  No shuffle.
    """

    def source(name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

    title, level = F.col("_title"), F.col("_level")
    prepared = bind(with_folded(df), {"_signals": folded_signals(), "_context": folded_context()})
    prepared = bind(
        prepared,
        {
            "_edited": F.size("_signals") > 0,
            "_signal_text": F.array_join("_signals", ", "),
            "_event": first_pattern(title, [fv.EVENT_SUBTYPE]),
            "_technical": first_pattern(title, fv.TECHNICAL_SUBTYPES),
            "_book": first_pattern(title, fv.BOOK_SUBTYPES),
            "_special": first_pattern(title, fv.SPECIAL_SUBTYPES),
            "_hint": first_pattern(
                F.col("_context"), [*fv.TECHNICAL_SUBTYPES, fv.EVENT_SUBTYPE, *fv.BOOK_SUBTYPES]
            ),
        },
    )
    edited, signals = F.col("_edited"), F.col("_signal_text")
    signals_or_none = F.when(edited, signals).otherwise("ninguna")
    event, technical = F.col("_event"), F.col("_technical")
    book, special, hint = F.col("_book"), F.col("_special"), F.col("_hint")

    subtype_of = {k: v for k, (v, _) in fv.THESIS_LEVELS.items()}
    specific = level.isin([k for k, (_, sure) in fv.THESIS_LEVELS.items() if sure])
    # A missing level reads "nan" in the evidence text, as in the published audit.
    raw_level = F.coalesce(source(c.RAW_LEVEL).cast("string"), F.lit("nan"))
    default_confidence = F.when(edited, "Media").otherwise("Baja")
    default_review = F.when(edited, "NO").otherwise("SI")
    dataset = special["label"] == fv.DATASET_SUBTYPE

    proposal = (
        F.when(
            F.col("_type") == "tesis",
            _proposal(
                fv.THESIS,
                t.lookup(level, subtype_of, F.lit(fv.THESIS_LEVEL_UNKNOWN)),
                F.when(specific, "Alta").otherwise("Baja"),
                F.when(specific, "NO").otherwise("SI"),
                F.concat(F.lit("Tipo original=Tesis; nivel original="), raw_level),
                "TESIS_NIVEL_ORIGINAL",
            ),
        )
        .when(
            F.col("_type") == "articulo de conferencia",
            _proposal(
                fv.ARTICLE,
                fv.EVENT_PUBLICATION,
                "Alta",
                "NO",
                "Tipo original=Artículo de conferencia",
                "EVENTO_TIPO_ORIGINAL",
            ),
        )
        .when(
            event.isNotNull() & ~edited,
            _proposal(
                fv.ARTICLE,
                fv.EVENT_PUBLICATION,
                "Media",
                "SI",
                F.concat(F.lit("Indicador en título: "), event["found"]),
                "EVENTO_POR_TITULO",
            ),
        )
        .when(
            technical.isNotNull() & edited,
            _proposal(
                fv.ARTICLE,
                fv.SCIENTIFIC_ARTICLE,
                "Baja",
                "SI",
                F.concat(
                    F.lit("Indicador en título: "), technical["found"], F.lit("; conflicto con "), signals
                ),
                "TECNICO_CON_CONFLICTO_EDITORIAL",
            ),
        )
        .when(
            technical.isNotNull(),
            _proposal(
                "Documento técnico",
                technical["label"],
                "Media",
                "SI",
                F.concat(
                    F.lit("Indicador en título: "), technical["found"], F.lit("; sin señales editoriales")
                ),
                "TECNICO_POR_TITULO",
            ),
        )
        .when(
            book.isNotNull() & edited,
            _proposal(
                fv.ARTICLE,
                fv.SCIENTIFIC_ARTICLE,
                "Media",
                "SI",
                F.concat(
                    F.lit("Indicador bibliográfico en título: "),
                    book["found"],
                    F.lit("; conflicto con "),
                    signals,
                ),
                "LIBRO_CON_CONFLICTO_EDITORIAL",
            ),
        )
        .when(
            book.isNotNull(),
            _proposal(
                "Libro",
                book["label"],
                "Media",
                "SI",
                F.concat(F.lit("Indicador en título: "), book["found"]),
                "LIBRO_POR_TITULO",
            ),
        )
        .when(
            special.isNotNull() & dataset & edited,
            _proposal(
                fv.ARTICLE,
                fv.SCIENTIFIC_ARTICLE,
                "Media",
                "SI",
                F.concat(
                    F.lit("Indicador en título: "), special["found"], F.lit("; conflicto con "), signals
                ),
                "DATOS_CON_CONFLICTO_EDITORIAL",
            ),
        )
        .when(
            special.isNotNull(),
            _proposal(
                F.when(dataset, "Datos de investigación").otherwise(fv.ARTICLE),
                special["label"],
                "Media",
                "SI",
                F.concat(
                    F.lit("Indicador en título: "), special["found"], F.lit("; señales: "), signals_or_none
                ),
                "SUBTIPO_POR_TITULO",
            ),
        )
        .when(
            hint.isNotNull(),
            _proposal(
                fv.ARTICLE,
                fv.SCIENTIFIC_ARTICLE,
                "Baja",
                "SI",
                F.concat(
                    F.lit("Indicador solo en metadatos contextuales: "),
                    hint["found"],
                    F.lit("; señales: "),
                    signals_or_none,
                ),
                "ALERTA_CONTEXTO_SIN_RECLASIFICAR",
            ),
        )
        .otherwise(
            _proposal(
                fv.ARTICLE,
                fv.SCIENTIFIC_ARTICLE,
                default_confidence,
                default_review,
                F.when(edited, signals).otherwise("Sin señales editoriales estructuradas"),
                "ARTICULO_POR_DEFECTO",
            )
        )
    )
    return bind(prepared, {"_proposal": proposal}).select(
        *[F.col(f"`{x}`") for x in df.columns], "_proposal.*"
    )


def summary_mentions_master(summary: Column) -> Column:
    return F.coalesce(summary, F.lit("")).rlike(regex(fv.MASTER_SUMMARY, ignore_case=True))


def summary_mentions_doctorate(summary: Column) -> Column:
    return F.coalesce(summary, F.lit("")).rlike(regex(fv.DOCTORAL_SUMMARY, ignore_case=True))


def postgraduate_detail(kind: Column, subtype: Column, level: Column, summary: Column) -> Column:
    """Postgraduate detail of a thesis; null when it is not a postgraduate thesis.

    The summary tests apply to every thesis, also to those filed as undergraduate.
    """
    subtype, level = t.unicode_trim(subtype), t.unicode_trim(level)
    return (
        F.when(F.coalesce(t.unicode_trim(kind) != fv.THESIS, F.lit(True)), F.lit(None).cast("string"))
        .when((subtype == fv.MASTER_THESIS) | (level == "Maestría"), fv.MASTER_THESIS)
        .when((subtype == fv.DOCTORAL_THESIS) | (level == "Doctorado"), fv.DOCTORAL_THESIS)
        .when(summary_mentions_master(summary), fv.MASTER_THESIS)
        .when(summary_mentions_doctorate(summary), fv.DOCTORAL_THESIS)
        .when(subtype == fv.POSTGRAD_THESIS, fv.NOT_IDENTIFIED)
    )


def normalize_hierarchy(df: DataFrame) -> DataFrame:
    """Load-time normalisation of the type hierarchy.

    Events become articles, master and doctoral theses become a detail of the
    postgraduate subtype, and a missing detail is filled from the level.
    """
    if c.PUBLIC_TYPE not in df.columns or c.PUBLIC_SUBTYPE not in df.columns:
        return df
    kind, subtype = F.col(c.PUBLIC_TYPE), F.col(c.PUBLIC_SUBTYPE)
    detail = F.col(c.POSTGRAD_DETAIL) if c.POSTGRAD_DETAIL in df.columns else F.lit(None).cast("string")
    level = F.col(c.LEVEL) if c.LEVEL in df.columns else F.lit(None).cast("string")

    event = F.coalesce(t.unicode_trim(kind) == fv.EVENT_PUBLICATION, F.lit(False)) | F.coalesce(
        t.unicode_trim(subtype).isin(fv.EVENT_SUBTYPES), F.lit(False)
    )
    df = df.withColumns(
        {
            c.PUBLIC_TYPE: F.when(event, fv.ARTICLE).otherwise(kind),
            c.PUBLIC_SUBTYPE: F.when(event, fv.EVENT_PUBLICATION).otherwise(subtype),
        }
    )
    subtype = F.col(c.PUBLIC_SUBTYPE)
    postgraduate = subtype.isin(
        fv.MASTER_THESIS, fv.DOCTORAL_THESIS, fv.POSTGRAD_THESIS, fv.POSTGRAD_UNSPECIFIED
    )
    filled = (
        F.when(subtype.isin(fv.MASTER_THESIS, fv.DOCTORAL_THESIS), subtype)
        .when(~F.coalesce(postgraduate, F.lit(False)) | detail.isNotNull(), detail)
        .when(level == "Maestría", fv.MASTER_THESIS)
        .when(level == "Doctorado", fv.DOCTORAL_THESIS)
        .otherwise(fv.NOT_IDENTIFIED)
    )
    return df.withColumns(
        {
            c.POSTGRAD_DETAIL: filled,
            c.PUBLIC_SUBTYPE: F.when(postgraduate, fv.POSTGRAD_THESIS).otherwise(subtype),
        }
    )


