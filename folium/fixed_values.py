"""Fixed values of the catalogue.

Everything in this module is data, not logic: labels, word lists, lookup tables,
patterns and expected counts that have to match the published catalogue so that
results agree with it.  Keys of the classifiers are in folded upper case.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Labels and sentinels
# --------------------------------------------------------------------------
OTHERS = "Otros"
OTHERS_LOWER = "otros"
NOT_APPLICABLE = "No aplica"
EMPTY_CATEGORIES = ["", "otros", "no aplica"]
ABSENT_LABELS = ["otros", "no aplica", "nan"]

ARTICLE = "Artículo"
THESIS = "Tesis"
SCIENTIFIC_ARTICLE = "Artículo científico"
CONFERENCE_ARTICLE = "Artículo de conferencia"
EVENT_PUBLICATION = "Publicación de evento científico"
MASTER_THESIS = "Tesis de maestría"
DOCTORAL_THESIS = "Tesis doctoral"
POSTGRAD_THESIS = "Tesis de posgrado"
POSTGRAD_UNSPECIFIED = "Tesis de posgrado no especificada"
NOT_IDENTIFIED = "No identificados"
LEVEL_NOT_IDENTIFIED = "No identificado"

EVENT_SUBTYPES = [
    "Artículo de conferencia",
    "Ponencia o memoria de evento",
    "Publicación de evento científico",
]

# --------------------------------------------------------------------------
# Database names
# --------------------------------------------------------------------------
DATABASE_PREFIX = r"^\d+\.\s*"
DATABASE_NAMES = {
    "Base estado del arte algarrobo": "Base estado del arte Algarrobo",
    "Base producción cientifica algarrobo": "Base producción científica Algarrobo",
    "Base producción cientifica Amazonas": "Base producción científica Amazonas",
    "Condor": "Cóndor",
    "Diagnostico Junin": "Diagnóstico Junín",
    "Diagnostico Madre de Dios": "Diagnóstico Madre de Dios",
    "Diagnostico Moquegua": "Diagnóstico Moquegua",
    "Diagnostico Puno": "Diagnóstico Puno",
    "Producción Cientifica AN,HU,PA,SM,CA": "Producción científica AN, HU, PA, SM, CA",
    "Producción científica shihuahuaco": "Producción científica Shihuahuaco",
}

# --------------------------------------------------------------------------
# Journals found in the institution column -> institution that publishes them
# --------------------------------------------------------------------------
MISPLACED_JOURNALS = {
    "Anales del Jardín Botánico de Madrid": "Jardín Botánico de Madrid",
    "Annals of the American Association of Geographers": "American Association of Geographers",
    "Annals of the Missouri Botanical Garden": "Missouri Botanical Garden",
    "Biological Journal of the Linnean Society": "Linnean Society",
    "Boletín Sociedad Entomológica Aragonesa": "Sociedad Entomológica Aragonesa",
    "Boletín de la Sociedad Argentina de Botánica": "Sociedad Argentina de Botánica",
    "Boletín de la Sociedad Geográfica de Lima": "Sociedad Geográfica de Lima",
    "Boletín del Instituto del Mar del Perú": "Instituto del Mar del Perú",
    "Botanical Journal of the Linnean Society": "Linnean Society",
    "PROCEEDINGS-ENTOMOLOGICAL SOCIETY OF WASHINGTON": "Entomological Society of Washington",
    "Proceedings of the Biological Society of Washington": "Biological Society of Washington",
    "Proceedings of the Entomological Society of Washington": "Entomological Society of Washington",
    "Proceedings of the Royal Society B: Biological Sciences": "Royal Society",
    "Proceedings of the Zoological Institute of the Russian Academy of Sciences":
        "Zoological Institute of the Russian Academy of Sciences",
    "The Society of Wetland Scientists Bulletin": "Society of Wetland Scientists",
    "Zoologische Abhandlungen Staatliches Museum für Tierkunde Dresden":
        "Staatliches Museum für Tierkunde Dresden",
}
JOURNAL_KEPT = "conservado"
JOURNAL_MOVED = "migrado_a_nombre_revista"
JOURNAL_RULE = (
    "Valor con apariencia de revista/boletín en institución; "
    "se migra a nombre de revista si el campo estaba vacío u Otros."
)

# --------------------------------------------------------------------------
# Academic levels
# --------------------------------------------------------------------------
# Raw level -> (grade, level, family of the conflict audit), most specific first.
LEVEL_PRECEDENCE = [
    ("Doctorado", "Posgrado", "Doctorado", "Posgrado"),
    ("Maestría", "Posgrado", "Maestría", "Posgrado"),
    ("Suficiencia profesional", "Pregrado", "Suficiencia profesional", "Pregrado"),
    ("Pregrado", "Pregrado", "Pregrado", "Pregrado"),
    ("Posgrado no especificado", "Posgrado", "Otros", "Posgrado"),
]
CONFLICT_CONTRADICTORY = "grados_contradictorios"
CONFLICT_MULTIPLE = "niveles_multiples"
CONFLICT_RULE = "Priorizar el nivel académico más específico."

# --------------------------------------------------------------------------
# Institution taxonomy
# --------------------------------------------------------------------------
INST_PUBLIC_UNIVERSITY = "Universidad publica nacional"
INST_PRIVATE_UNIVERSITY = "Universidad privada nacional"
INST_FOREIGN_UNIVERSITY = "Universidad extranjera"
INST_STATE = "Instituto publico / entidad estatal"
INST_CENTRE = "Centro de investigacion / cooperacion"
INST_SOCIETY = "Sociedad cientifica / asociacion"
INST_JOURNAL = "Revista / boletin mal ubicado"
UNCLASSIFIED = "Otro / no clasificado"

INSTITUTION_CLASSES = [
    INST_PUBLIC_UNIVERSITY,
    INST_PRIVATE_UNIVERSITY,
    INST_FOREIGN_UNIVERSITY,
    INST_STATE,
    INST_CENTRE,
    INST_SOCIETY,
    INST_JOURNAL,
    UNCLASSIFIED,
]

# Technical class -> (public class, university subclass).
PUBLIC_INSTITUTION = {
    INST_PUBLIC_UNIVERSITY: ("Universidad nacional", "Pública"),
    INST_PRIVATE_UNIVERSITY: ("Universidad nacional", "Privada"),
    INST_FOREIGN_UNIVERSITY: ("Universidad extranjera", "Extranjera"),
    INST_STATE: ("Instituto público / entidad estatal", "No aplica"),
    INST_CENTRE: ("Centro de investigación / cooperación", "No aplica"),
    INST_SOCIETY: ("Centro de investigación / cooperación", "No aplica"),
    INST_JOURNAL: ("Revista / boletín mal ubicado", "No aplica"),
    UNCLASSIFIED: ("Otros", "No aplica"),
}
PUBLIC_INSTITUTION_CLASSES = [
    "Universidad nacional",
    "Universidad extranjera",
    "Instituto público / entidad estatal",
    "Centro de investigación / cooperación",
    "Revista / boletín mal ubicado",
    "Otros",
]
REQUIRED_PUBLIC_INSTITUTION_CLASSES = [
    "Universidad nacional",
    "Universidad extranjera",
    "Centro de investigación / cooperación",
]
UNIVERSITY_SUBCLASSES = ["Pública", "Privada", "Extranjera", "No aplica"]

JOURNAL_MARKERS = [
    "BOLETIN",
    "JOURNAL",
    "ANNALS",
    "ANALES",
    "PROCEEDINGS",
    "BULLETIN",
    "CONSERVATION & SOCIETY",
    "NATURALEZA Y SOCIEDAD",
    "ZOOLOGISCHE ABHANDLUNGEN",
    "APUNTES DE CIENCIA & SOCIEDAD",
]
SOCIETY_MARKERS = ["SOCIEDAD", "SOCIETY", "ASSOCIATION", "ACADEMIA", "ACADEMY"]
PUBLIC_ENTITIES = [
    "CONSEJO NACIONAL DE CIENCIA TECNOLOGIA E INNOVACION TECNOLOGICA",
    "INSTITUTO NACIONAL DE INNOVACION AGRARIA",
    "INSTITUTO PERUANO DE ENERGIA NUCLEAR",
    "INSTITUTO DE INVESTIGACION DE LA AMAZONIA PERUANA",
    "INSTITUTO DE INVESTIGACIONES DE LA AMAZONIA PERUANA",
    "MINISTERIO DEL AMBIENTE",
]
RESEARCH_CENTRES = [
    "CENTRO DE COOPERACION INTERNACIONAL EN INVESTIGACION AGRICOLA PARA EL DESARROLLO",
    "CENTRO DE PREPARACION PARA LA CIENCIA Y TECNOLOGIA",
    "INSTITUTO DE NEUROCIENCIA COGNITIVA Y TRASLACIONAL (INCYT)",
    "INSTITUTO DE PESQUISAS E ESTUDOS FLORESTAIS",
    "INTERNATIONAL INSTITUTE OF SOCIAL STUDIES",
]
PRIVATE_UNIVERSITIES = [
    "PONTIFICIA UNIVERSIDAD CATOLICA DEL PERU",
    "UNIVERSIDAD ALAS PERUANAS",
    "UNIVERSIDAD ANDINA NESTOR CACERES VELASQUEZ",
    "UNIVERSIDAD ANDINA DEL CUSCO",
    "UNIVERSIDAD ANTONIO RUIZ DE MONTOYA",
    "UNIVERSIDAD CATOLICA SAN PABLO",
    "UNIVERSIDAD CATOLICA SANTO TORIBIO DE MOGROVEJO",
    "UNIVERSIDAD CATOLICA SEDES SAPIENTIAE",
    "UNIVERSIDAD CATOLICA DE SANTA MARIA",
    "UNIVERSIDAD CATOLICA LOS ANGELES DE CHIMBOTE",
    "UNIVERSIDAD CATOLICA DE LOJA",
    "UNIVERSIDAD CIENTIFICA DEL PERU",
    "UNIVERSIDAD CIENTIFICA DEL SUR",
    "UNIVERSIDAD CONTINENTAL",
    "UNIVERSIDAD CESAR VALLEJO",
    "UNIVERSIDAD ESAN",
    "UNIVERSIDAD INCA GARCILASO DE LA VEGA",
    "UNIVERSIDAD JESUITA RUIZ DE MONTOYA",
    "UNIVERSIDAD JOSE CARLOS MARIATEGUI",
    "UNIVERSIDAD LATINOAMERICANA CIMA",
    "UNIVERSIDAD LE CORDON BLEU",
    "UNIVERSIDAD PERUANA CAYETANO HEREDIA",
    "UNIVERSIDAD PERUANA LOS ANDES",
    "UNIVERSIDAD PERUANA UNION",
    "UNIVERSIDAD PERUANA DE CIENCIAS APLICADAS",
    "UNIVERSIDAD PRIVADA ANTENOR ORREGO",
    "UNIVERSIDAD PRIVADA ANTONIO GUILLERMO URRELO",
    "UNIVERSIDAD PRIVADA AUTONOMA DEL SUR",
    "UNIVERSIDAD PRIVADA NORBERT WIENER",
    "UNIVERSIDAD PRIVADA DE TACNA",
    "UNIVERSIDAD PRIVADA DEL NORTE",
    "UNIVERSIDAD RICARDO PALMA",
    "UNIVERSIDAD SAN IGANCIO DE LOLYOLA",
    "UNIVERSIDAD SAN IGNACIO DE LOYOLA",
    "UNIVERSIDAD SENOR DE SIPAN",
    "UNIVERSIDAD TECNOLOGICA DE LOS ANDES",
    "UNIVERSIDAD TECNOLOGICA DEL PERU",
    "UNIVERSIDAD DE HUANUCO",
    "UNIVERSIDAD DE LAMBAYEQUE",
    "UNIVERSIDAD DE LIMA",
    "UNIVERSIDAD DE PIURA",
    "UNIVERSIDAD DE SAN MARTIN DE PORRES",
]
PUBLIC_UNIVERSITY_ALIASES = [
    "UNIVERSIDAD DE LA AMAZONIA PERUANA",
    "UNIVERSIDAD DE PUNO",
    "UNIVERSIDAD PEDRO RUIZ GALLO",
]
FOREIGN_UNIVERSITIES = [
    "CENTRAL EUROPEAN UNIVERSITY",
    "ESCUELA DE FORMACION INTERNACIONAL (SIT GRADUATE INSTITUTE)",
    "INSTITUTO DE BIOCIENCIAS USP",
    "UNIVERSIDAD CATOLICA DE LOJA",
    "UNIVERSIDAD FEDERAL DO PARANA",
    "UNIVERSIDAD MAYOR DE SAN ANDRES",
    "UNIVERSIDAD NACIONAL DONG HWA",
    "UNIVERSIDAD NACIONAL DE LA PLATA",
    "UNIVERSIDAD NACIONAL DEL COMAHUE",
    "UNIVERSIDAD POLITECNICA DE MADRID",
    "UNIVERSIDAD DE ALICANTE",
    "UNIVERSIDAD DE CHILE",
    "UNIVERSIDAD DE CONCEPCION",
    "UNIVERSIDAD DE CORDOBA",
    "UNIVERSIDAD DE GUAYAQUIL",
    "UNIVERSIDAD DE MONTPELLIER, UNIVERSIDAD PERUANA CAYETANO HERREDIA",
    "UNIVERSIDAD DE SALAMANCA",
    "UNIVERSIDAD DE SAO PAULO",
    "UNIVERSIDAD DE STANFORD",
    "UNIVERSIDAD DE VALLADOLID",
    "UNIVERSIDAD DE WISCOSIN-MADISON",
    "UNIVERSIDAD DE LA RIOJA",
    "UNIVERSIDAD DE LOS ANDES",
    "UNIVERSIDAD DEL AZUAY",
]
FOREIGN_UNIVERSITY_MARKERS = [
    "UNIVERSITY",
    "UNIVERSIDADE",
    "UNIVERSITAT",
    "COLLEGE",
    "ESCUELA POLITECNICA FEDERAL",
    "ESCUELA SUPERIOR POLITECNICA",
    "PONTIFICIA UNIVERSIDAD CATOLICA DEL ECUADOR",
    "SWISS FEDERAL INSTITUTE OF TECHNOLOGY",
    "INSTITUTO POLITECNICO Y UNIVERSIDAD ESTATAL DE VIRGINIA",
]

# --------------------------------------------------------------------------
# Repository taxonomy
# --------------------------------------------------------------------------
REPO_UNIVERSITY = "Repositorio universitario"
REPO_PUBLIC = "Repositorio institucional publico"
REPO_AGGREGATOR = "Repositorio nacional/regional"
REPO_SEARCH = "Buscador academico"
REPO_NETWORK = "Red academica / perfil de autor"
REPO_INDEX = "Base bibliografica / indexador"
REPO_PUBLISHER = "Editorial / plataforma de revistas"
REPO_JOURNAL = "Revista o portal especifico"
REPO_ARCHIVE = "Biblioteca / archivo digital"

REPOSITORY_CLASSES = [
    REPO_UNIVERSITY,
    REPO_PUBLIC,
    REPO_AGGREGATOR,
    REPO_SEARCH,
    REPO_NETWORK,
    REPO_INDEX,
    REPO_PUBLISHER,
    REPO_JOURNAL,
    REPO_ARCHIVE,
    UNCLASSIFIED,
]

PUB_SEARCH = "Buscadores académicos"
PUB_INSTITUTIONAL = "Repositorios institucionales"
PUB_UNIVERSITY = "Repositorios universitarios"
PUB_JOURNALS = "Revistas"
PUBLIC_REPOSITORY_CLASSES = [PUB_SEARCH, PUB_INSTITUTIONAL, PUB_UNIVERSITY, PUB_JOURNALS, OTHERS]

# Technical class -> (public class, rule id, needs review).
PUBLIC_REPOSITORY = {
    REPO_SEARCH: (PUB_SEARCH, "REP_PUBLICA_001", "No"),
    REPO_NETWORK: (PUB_SEARCH, "REP_PUBLICA_001", "No"),
    REPO_INDEX: (PUB_SEARCH, "REP_PUBLICA_001", "No"),
    REPO_AGGREGATOR: (PUB_SEARCH, "REP_PUBLICA_001", "No"),
    REPO_PUBLIC: (PUB_INSTITUTIONAL, "REP_PUBLICA_002", "No"),
    REPO_ARCHIVE: (PUB_INSTITUTIONAL, "REP_PUBLICA_002", "No"),
    REPO_UNIVERSITY: (PUB_UNIVERSITY, "REP_PUBLICA_003", "No"),
    REPO_PUBLISHER: (PUB_JOURNALS, "REP_PUBLICA_004", "No"),
    REPO_JOURNAL: (PUB_JOURNALS, "REP_PUBLICA_004", "No"),
    UNCLASSIFIED: (OTHERS, "REP_PUBLICA_005_PENDIENTE_REVISION", "Si"),
}
# Requested public class -> (technical class, university flag).
REQUESTED_REPOSITORY = {
    PUB_SEARCH: (REPO_SEARCH, "No"),
    PUB_INSTITUTIONAL: (REPO_PUBLIC, "No"),
    PUB_UNIVERSITY: (REPO_UNIVERSITY, "Si"),
    PUB_JOURNALS: (REPO_JOURNAL, "No"),
}
REPOSITORY_REQUEST_RULES = ["REP_SOLICITADA_20260630", "REP_EVALUADA_20260630"]

REPOSITORY_BLANKS = ["OTROS", "REPOSITORIO", "PUBLICACIONES"]
SEARCH_ENGINES = ["GOOGLE", "GOOGLE SCHOLAR", "GOOHLE SCHOLAR", "SEMANTIC SCHOLAR"]
ACADEMIC_NETWORKS = ["ACADEMIA.EDU", "AUTHOREA", "RESEARCHGATE", "RESEARCHGATE."]
NATIONAL_AGGREGATORS = [
    "ALICIA",
    "LICIA",
    "RENATI",
    "LA REFERENCIA",
    "CORE",
    "CORE.UK",
    "DIALNET",
    "REDALYC",
    "SCIELO",
]
BIBLIOGRAPHIC_INDEXES = [
    "AGRIS",
    "AGRITOP",
    "CABDIRECT",
    "CITESEERX",
    "INGENTACONNECT",
    "JSTOR",
    "NCBI",
    "PROQUEST",
    "PUBMED",
    "PUDMED",
    "SCOPUS",
]
JOURNAL_PORTALS = ["CHECKLIST", "PHYTOKEYS"]
PUBLISHER_PLATFORMS = [
    "AGUPUBS",
    "ANNUARL REVIEWS",
    "ANTHROSOURCE",
    "BESJOURNALS",
    "BETHAMOPEN",
    "BIOONE",
    "BIOTAXA",
    "CAMBRIDGE CORE",
    "CAMBRIGE UNIVERISTY",
    "CANADIAN SCIENCE PUBLISHING",
    "COPERNICUS PUBLICATIONS",
    "DUKE UNIVERSITY",
    "EGU",
    "ESA JOURNALS",
    "EUROPEAN GEOSCIENCE UNION",
    "FRONTIERSIN",
    "HINDAWI",
    "IOPSCIENCE",
    "LOPSCIENCE",
    "MDPI",
    "NATURE",
    "NEW PHYTOLOGIST",
    "OXFORD ACADEMIC",
    "PEERJ",
    "PENSOFT",
    "PLOS ONE",
    "PNAS",
    "ROYAL SOCIETY PUBLISHING",
    "ROYALTY SOCIETY",
    "SAGEPUB",
    "SCIENCE DIRECT",
    "SCIENCEADVANCE",
    "SPRINGER",
    "SPRINGER LINK",
    "TADFONELINE",
    "TAYLOR & FRANCIS",
    "WILEY ONLINE LIBRARY",
    "ZSLPUBLICATIONS",
]
LIBRARY_ARCHIVES = [
    "BIODIVERSITY HERITAGE LIBRARY BHL",
    "CEU ETD COLLECTION",
    "DIGITAL COLLECTIONS",
    "DIGITALCOOMONS",
    "DIGILTAL LIBRAY WASHIGTON U.",
    "DOCUMENTAL GREDOS",
    "DOMINIO PUBLICO",
    "LIBRARY",
    "SIT DIGITAL COLLECTIONS",
]
LIBRARY_MARKERS = ["LIBRARY", "COLLECTION"]
PUBLIC_INSTITUTION_REPOSITORIES = [
    "AEMNP",
    "BAN",
    "CATIE",
    "CEPROSIMAD",
    "CICADFOR",
    "CIFOR",
    "CINCIA",
    "CONCYTEC",
    "CORBIDI",
    "DBCA",
    "ECOSUR",
    "EQUATORIAN INITIATIVE",
    "FOREST SERVICE -U.S. DEPARTMENT OF AGRICULTURE",
    "ICRAF",
    "IGP",
    "IIAP",
    "IMARPE",
    "INAIGEM",
    "INIA",
    "INS",
    "INSTITUO NACIONAL DE INNOVACION AGRARIA",
    "MINAM",
    "REPOSITORIO INIA",
    "REPOSITORIO SERNAMP",
    "REPOSITORIO SERNANP",
    "SERFOR",
    "SERNANP",
    "USDA",
]
UNIVERSITY_REPOSITORIES = [
    "ALAS PERUANAS",
    "CONTINENTAL",
    "COOMMOS CLARK UNIVERSITY",
    "CUNY ACADEMICS WORKS",
    "DEEPBLUE",
    "DUKESPACE",
    "ESPOCH",
    "ESCUELA SUPERIOR POLITECNICA DE CHIMBORAZO",
    "ESCOLARSHIP ORG.",
    "ETH ZURICH'S RESEARCH COLLECTION",
    "FIAT LUX",
    "LA MOLINA",
    "OAKTRUST",
    "PLURIVERSIDAD RICARDO PALMA",
    "PUCP",
    "RE.PUBLIC",
    "REPEBIS UPCH",
    "REPOSITORIO INSTITUCIONAL - CONTINENTAL",
    "REPOSITORIO PIRHUA",
    "REPOSITORIO UNALM",
    "REPOSITORIO UNC",
    "SCHOLARWORKS",
    "SIIS UNMAS",
    "TCU",
    "TESIS PUCP",
    "UDISTRITAL",
    "UMANIZALES",
    "UNIVERSIDAD DE CHILE",
    "UNIVERSIDAD INCA GARCILAZO DE LA VEGA",
    "UNIVERSIDAD NACIONAL DEL ALTIPLANO",
    "UNIVERSIDAD PERUANA LOS ANDES",
    "UNIVERSIDAD POLITECNICA",
    "UNIVERSIDADES",
    "VIRGINA TECH WORKS",
]
UNIVERSITY_ACRONYMS = [
    "UAC", "UANDINA", "UAP", "UARM", "UC", "UCALDAS", "UCSS", "UCSUR",
    "UCUNDINAMARCA", "UCV", "UDEP", "UDH", "UDL", "UFMG", "UIGV", "UISEK",
    "UMSA", "UNA", "UNACH", "UNAJ", "UNALM", "UNAMAD", "UNAMBA", "UNAP",
    "UNAS", "UNASAM", "UNC", "UNCHILE", "UNCP", "UNDAC", "UNESUM", "UNFV",
    "UNH", "UNHEVAL", "UNICA", "UNICAM", "UNITRU", "UNJ", "UNJBG", "UNLP",
    "UNMBA", "UNMSAM", "UNMSM", "UNPRG", "UNS", "UNSA", "UNSAAC", "UNSCH",
    "UNSM", "UNT", "UNTRM", "UNTUMBES", "UNU", "UPC", "UPCH", "UPLA", "UPM",
    "UPTC", "UPV", "UQROO", "URP", "USC", "USIL", "USMP", "USP", "USTA",
    "UTA", "UTP", "WFU",
]

# --------------------------------------------------------------------------
# Document types: words searched in folded titles, in order of precedence
# --------------------------------------------------------------------------
TYPE_PATTERNS = {
    "Informe técnico": r"\b(informe tecnico|technical report|research report|rapport technique)\b",
    "Documento de trabajo": r"\b(documento de trabajo|working paper|discussion paper|document de travail)\b",
    "Boletín técnico": r"\b(boletin tecnico|technical bulletin|research bulletin)\b",
    "Manual o guía": r"\b(manual|guia (?:tecnica|practica|metodologica)|handbook|field guide|guide to)\b",
    "Protocolo": r"\b(protocolo|protocol for|protocol manual)\b",
    "Plan o estrategia": r"\b(plan (?:de|nacional|regional)|estrategia (?:de|nacional|regional)|action plan|management plan)\b",
    "Diagnóstico o evaluación": r"\b(diagnostico|diagnostic report|evaluacion (?:tecnica|ambiental)|assessment report)\b",
    "Capítulo de libro": r"\b(capitulo (?:de|del) libro|book chapter|chapter \d+|chapter in)\b",
    "Libro o monografía": r"\b(monografia|monograph|edited book|libro)\b",
    "Artículo de revisión": r"\b(revision (?:sistematica|bibliografica|de literatura)|systematic review|literature review|review article|meta-analysis|metaanalisis)\b",
    "Nota científica": r"\b(nota cientifica|scientific note|short communication|research note|nota breve)\b",
    "Publicación de evento": r"\b(congreso|conference|symposium|simposio|proceedings|conference paper|ponencia|poster)\b",
    "Conjunto de datos": r"\b(dataset|data set|conjunto de datos|data paper)\b",
}
TECHNICAL_SUBTYPES = [
    "Informe técnico",
    "Documento de trabajo",
    "Boletín técnico",
    "Manual o guía",
    "Protocolo",
    "Plan o estrategia",
    "Diagnóstico o evaluación",
]
BOOK_SUBTYPES = ["Capítulo de libro", "Libro o monografía"]
SPECIAL_SUBTYPES = ["Artículo de revisión", "Nota científica", "Conjunto de datos"]
EVENT_SUBTYPE = "Publicación de evento"
DATASET_SUBTYPE = "Conjunto de datos"

# URL fragment -> label of the editorial signal.
EDITORIAL_DOMAINS = {
    "sciencedirect": "portal editorial",
    "redalyc": "portal editorial",
    "ncbi.nlm.nih.gov/pmc/articles": "artículo en PMC",
    "bioone.org/journals": "portal editorial",
    "copernicus.org/articles": "portal editorial",
    "scielo": "portal editorial",
    "springer.com/article": "portal editorial",
    "link.springer.com/article": "portal editorial",
    "tandfonline.com": "portal editorial",
    "wiley.com/doi": "portal editorial",
}
# Folded raw level -> (thesis subtype, is the level specific).
THESIS_LEVELS = {
    "doctorado": ("Tesis doctoral", True),
    "maestria": ("Tesis de maestría", True),
    "pregrado": ("Tesis de pregrado", True),
    "suficiencia profesional": ("Trabajo de suficiencia profesional", True),
    "posgrado no especificado": ("Tesis de posgrado", True),
    "nivel no especificado": ("Tesis de nivel no especificado", False),
    "otros": ("Tesis de nivel no especificado", False),
}
THESIS_LEVEL_UNKNOWN = "Tesis de nivel no especificado"

AUDIT_PRINCIPLES = [
    ("Principio", "No modificar automáticamente el maestro; toda inferencia queda trazable."),
    ("Tesis", "Usar el tipo y nivel originales; los niveles no especificados requieren revisión."),
    ("Evento", "Aceptar el tipo original; por palabras del título, proponer con revisión."),
    ("Documento técnico", "Proponer solo con indicador explícito en título y sin DOI/revista/volumen/número."),
    ("Conflicto editorial", "Si un título parece técnico pero tiene señales de revista, conservar Artículo y revisar."),
    ("Libro", "Proponer por indicador explícito; requiere revisión porque no hay ISBN ni tipo editorial estructurado."),
    ("Artículo", "Conservar como categoría residual; la ausencia de señales editoriales reduce la confianza."),
    ("Revista", "Es medio/fuente de publicación, no tipo documental."),
]

# Raw (unfolded) summaries.
MASTER_SUMMARY = (
    r"\b(tesis de maestr[ií]a|master[’']*s? thesis|master[’']*s? dissertation|"
    r"msc thesis|m\.sc\. thesis|grado de mag[ií]ster|degree of master|"
    r"maestr[ií]a|mag[ií]ster)\b"
)
DOCTORAL_SUMMARY = (
    r"\b(tesis doctoral|doctoral thesis|doctoral dissertation|"
    r"ph\.?\s*d\.? (?:thesis|dissertation)|doctor of philosophy|"
    r"grado de doctor|degree of doctor|doctorado)\b"
)

# --------------------------------------------------------------------------
# Data contract and expected values of the published snapshot
# --------------------------------------------------------------------------
PUBLIC_TYPES = ["Artículo", "Tesis"]
PUBLIC_SUBTYPES = [
    "Artículo científico",
    "Artículo de revisión",
    "Nota científica",
    "Tesis de pregrado",
    "Tesis de posgrado",
    "Tesis de nivel no especificado",
    "Trabajo de suficiencia profesional",
    "Publicación de evento científico",
]
PUBLIC_GRADES = ["Pregrado", "Posgrado", "Otros"]
PUBLIC_LEVELS = [
    "Pregrado",
    "Maestría",
    "Doctorado",
    "Suficiencia profesional",
    "No identificado",
    "Otros",
]
UNIVERSITY_FLAGS = ["Si", "No", "Indeterminado"]
REVIEW_FLAGS = ["Si", "No"]

EXPECTED_PUBLICATIONS = 6217
EXPECTED_RECORDS = 6574
EXPECTED_REPOSITORY_DECISIONS = 135
EXPECTED_POSTGRAD = {
    "Tesis de maestría": 54,
    "Tesis doctoral": 24,
    "No identificados": 389,
}
EXPECTED_EVENTS = 6

# (table, purpose, key) rows of the contract that do not depend on the run.
CONTRACT_ROWS = [
    ("BD_APP", "Una fila por publicación consolidada", "ID_PUBLICACION_PROPUESTA"),
    ("REGISTROS_ORIGEN", "Registros homologados sin eliminación", "ID_REGISTRO_ANALISIS"),
    ("REGISTRO_PUBLICACION", "Relación auditable registro-publicación", "ID_REGISTRO_ANALISIS"),
    ("DECISIONES_REVISADAS", "Adjudicación de los 72 pares", "id_registro_a + id_registro_b"),
    ("AUDITORIA_ACADEMICA", "Combinaciones académicas resueltas", "ID_PUBLICACION_PROPUESTA"),
    ("AUDITORIA_INSTITUCIONES",
     "Migración de revistas o boletines desde institución hacia nombre de revista",
     "ID_REGISTRO_ANALISIS"),
    ("AUDITORIA_REPOSITORIOS",
     "Nombres y clases de repositorio actualizados por solicitud",
     "ID_PUBLICACION_PROPUESTA"),
    ("REGISTRO_MAESTRO_IDS", "Claves de identidad persistentes", "CLAVE_IDENTIDAD"),
    ("FUSIONES_IDS", "Alias de identificadores históricos", "ID_PUBLICACION_ALIAS"),
]
CONTRACT_BRIDGE = ("Relación publicación-categoría", "ID_PUBLICACION_PROPUESTA + categoria")
CONTRACT_TERRITORY = "Componente territorial integrado"
