"""A small synthetic catalogue that holds every case the jobs must treat."""

from __future__ import annotations

from folium import columns as c
from folium.plans.consolidate import ConsolidationInputs

RECORD_COLUMNS = [
    c.RECORD, c.ORD, c.MASTER_KEY, c.DATABASE, c.TITLE, c.YEAR, c.RAW_TYPE, c.TYPE_NORM, c.RAW_LEVEL,
    c.INSTITUTION, c.JOURNAL, c.REPOSITORY, c.LANGUAGE, c.SCOPE, c.REGION, c.SUMMARY,
]
# record, publication: P1 three records, P2 two theses, P3 mixed type, P4..P9 single.
RECORDS = [
    ("R01", 1, "K1", "19. Zeta", "Peces", "2015.0", "Artículo", "Artículo", None, "Universidad de Lima", "Rev A", "Scopus", "es", "Nacional", "Áncash", None),
    ("R02", 2, "K1", "3. Alfa", "Peces", "2015", "Artículo", "Artículo", None, "Universidad  de Lima", None, "Alicia", "es", "Nacional", "Áncash", None),
    ("R03", 3, "K1", "Zeta", "Peces", None, "Artículo", "Artículo", None, "Otros", None, "Scopus", "es", "Nacional", "Áncash", None),
    ("R04", 4, "K2", "Alfa", "Tesis A", "2001", "Tesis", "Tesis", "Pregrado", "Universidad Nacional de Puno", None, "UNALM", "es", "Nacional", "Ucayali", "x"),
    ("R05", 5, "K2", "Condor", "Tesis A", "2001", "Tesis", "Tesis", "Maestría", "Universidad Nacional de Puno", None, "UNALM", "es", "Nacional", "Ucayali", "x"),
    ("R06", 6, "K3", "Alfa", "Tesis B", "2005", "Artículo", "Artículo", None, "Yale University", None, "Blog raro", "en", "Extranjera", "Ucayali; Áncash", None),
    ("R07", 7, "K3", "Alfa", "Tesis B", "2005", "Tesis", "Tesis", "Doctorado", "Yale University", None, "Otros", "en", "Extranjera", "Ucayali; Áncash", None),
    ("R08", 8, "K4", "Alfa", "Evento", "2010", "Artículo de conferencia", "Artículo de conferencia", None,
     "Boletín de la Sociedad Geográfica de Lima", "Otros", "SERFOR", "es", "Nacional", "Otros", None),
    ("R09", 9, "K5", "Alfa", "Cinco", "s/f", "Artículo", "Artículo", None, "Journal of X", "Rev B", "PeerJ", "en", "Extranjera", None, None),
    ("R10", 10, "K6", "Beta", "Seis", "2012", "Tesis", "Tesis", "No aplica", None, None, "UNALM", "es", "Nacional", "Otros", None),
    ("R11", 11, "K7", "Beta", "Siete", "2013", "Tesis", "Tesis", "Posgrado no especificado", "Centro X", None, "UNALM", "es", "Nacional", "Ucayali", "Tesis de MAESTRÍA"),
    ("R12", 12, "K8", "Beta", "Ocho", "2014", "Tesis", "Tesis", "Suficiencia profesional", "Centro X", None, "UNALM", "es", "Nacional", "Ucayali", None),
    ("R13", 13, "K9", "Beta", "Nueve", "2016", "Tesis", "Tesis", "Doctorado", "Centro X", None, "Otros", "es", "Nacional", "Áncash", None),
]
PUBLICATION_OF = {
    "R01": "P1", "R02": "P1", "R03": "P1", "R04": "P2", "R05": "P2", "R06": "P3", "R07": "P3",
    "R08": "P4", "R09": "P5", "R10": "P6", "R11": "P7", "R12": "P8", "R13": "P9",
}
REPRESENTATIVE = {"P1": "R02", "P2": "R04", "P3": "R06", "P4": "R08", "P5": "R09", "P6": "R10", "P7": "R11", "P8": "R12", "P9": "R13"}
REQUESTS = [("P3", " Blog raro", "Portal nuevo", "Revistas"), ("P5", "PeerJ", "PeerJ", "Buscadores académicos")]


def table(spark, columns, rows, types=None):
    types = types or {}
    schema = ", ".join(f"`{x}` {types.get(x, 'string')}" for x in columns)
    return spark.createDataFrame(rows, schema)


def inputs(spark) -> ConsolidationInputs:
    long = {c.ORD: "long", c.ON_MAP: "boolean"}
    records = table(spark, RECORD_COLUMNS, RECORDS, long)
    sizes = {p: list(PUBLICATION_OF.values()).count(p) for p in REPRESENTATIVE}
    record_map = table(
        spark,
        [c.RECORD, c.PUB, c.REPRESENTATIVE, c.GROUP_SIZE, c.GROUP_RULES, c.STATE],
        [(r, p, REPRESENTATIVE[p], str(sizes[p]), None, "ok") for r, p in PUBLICATION_OF.items()],
    )
    ids = table(spark, [c.PUB, c.FINGERPRINT, c.FINGERPRINT_METHOD], [(p, f"h{p}", "m") for p in REPRESENTATIVE])
    bridge_columns = [c.RECORD, c.ORD, c.CATEGORY]

    def bridge(position):
        return table(spark, bridge_columns, [(r[0], r[1], r[position]) for r in RECORDS if r[position]], long)

    regions = [
        (r[0], 10 * r[1] + i, part)
        for r in RECORDS
        for i, part in enumerate((r[14] or "Otros").split("; "))
    ]
    territory = [
        (rec, o, part.upper().replace("Á", "A"), part, part != "Otros") for rec, o, part in regions
    ]
    return ConsolidationInputs(
        records=records,
        record_map=record_map,
        proposed_ids=ids,
        reviewed=table(spark, ["id_registro_a", "id_registro_b"], [("R01", "R02")]),
        id_registry=table(spark, [c.IDENTITY_KEY, c.PUB], [(f"k{p}", p) for p in REPRESENTATIVE]),
        id_merges=table(spark, ["ID_PUBLICACION_ALIAS", c.PUB], [("PX", "P1")]),
        bridges={
            c.DIM_REPOSITORIES: bridge(11),
            c.DIM_AREAS: bridge(12),
            c.DIM_AXES: bridge(13),
            c.DIM_LINES: bridge(4),
            c.DIM_REGIONS: table(spark, bridge_columns, regions, long),
        },
        territory=table(spark, [c.RECORD, c.ORD, c.DEP_KEY, c.DEP_NAME, c.ON_MAP], territory, long),
        departments=table(
            spark,
            [c.DEP_ID, c.DEP_NAME, c.DEP_KEY, c.DEP_CAPITAL],
            [("02", "Áncash", "ANCASH", "Huaraz"), ("25", "Ucayali", "UCAYALI", "Pucallpa"), ("23", "Tacna", "TACNA", "Tacna")],
        ),
        requests=[(table(spark, [c.PUB, c.REQUEST_OLD, c.REQUEST_NEW, c.REQUEST_CLASS], REQUESTS), "REP_EVALUADA_20260630", "solicitud.csv")],
        type_decisions=table(
            spark,
            [c.PUB, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE, c.POSTGRAD_DETAIL],
            [("P2", "Tesis", "Tesis de posgrado", "Tesis de maestría"), ("P6", "Tesis", "Tesis de nivel no especificado", None),
             ("P7", "Tesis", "Tesis de posgrado", "No identificados"), ("P8", "Tesis", "Trabajo de suficiencia profesional", None),
             ("P9", "Tesis", "Tesis de posgrado", "Tesis doctoral"), ("P1", None, "se ignora", None)],
        ),
        labels={"base_homologada": "registros"},
    )
