"""Fixed values.

These lists and numbers are part of the data contract: results are only right when they are
exactly as stated here.
"""

from __future__ import annotations

# Weight factor turning ferric oxide into ferrous oxide.
FE2O3_TO_FEO = 0.8998

# The ten major oxides (weight percent) and 26 trace elements (ppm).
MAJORS = ["NA2O", "MGO", "AL2O3", "SIO2", "P2O5", "K2O", "CAO", "TIO2", "MNO", "FEOT"]
TRACES = [
    "RB", "V", "CR", "CO", "NI", "BA", "SR", "Y", "ZR", "NB", "LA", "CE", "PR", "ND", "SM",
    "EU", "GD", "TB", "DY", "HO", "ER", "YB", "LU", "HF", "TA", "TH",
]
SHORT_FEATURES = MAJORS + TRACES
LONG_MAJORS = [f"{m}(WT%)" for m in MAJORS]
LONG_TRACES = [f"{t}(PPM)" for t in TRACES]
LONG_FEATURES = LONG_MAJORS + LONG_TRACES
SHORT_TO_LONG = dict(zip(SHORT_FEATURES, LONG_FEATURES))

# Majors that must be present for a row to be usable.
REQUIRED_MAJORS = ["SIO2", "AL2O3", "FEOT", "MGO", "CAO"]
REQUIRED_LONG_MAJORS = [SHORT_TO_LONG[m] for m in REQUIRED_MAJORS]

# The names an iron column can carry, by role.
IRON_COLUMNS = {
    "feot": ("FEOT(WT%)", ["FeOT (wt%)", "FEOT"]),
    "fe2o3t": ("FE2O3T(WT%)", ["Fe2O3T (wt%)", "FE2O3T"]),
    "feo": ("FEO(WT%)", ["FeO (wt%)", "FEO"]),
    "fe2o3": ("FE2O3(WT%)", ["Fe2O3 (wt%)", "FE2O3"]),
    "fe": ("FE(WT%)", ["Fe (wt%)", "FE"]),
}

# Alternative names per feature; every feature is also known by its short name,
# two of them by a duplicated-column suffix as well.
FEATURE_ALIASES = {long: [short] for short, long in SHORT_TO_LONG.items()}
FEATURE_ALIASES["CO(PPM)"] = ["CO", "CO.1"]
FEATURE_ALIASES["NI(PPM)"] = ["NI", "NI.1"]

# Alternative names of metadata columns in the second source.
METADATA_ALIASES = {
    "TECTONIC SETTING": ["Tectonic Setting"],
    "LONGITUDE": ["Longitude"],
    "LATITUDE": ["Latitude"],
    "AGE": ["Geologic Age"],
    "AGE PREFIX": ["Geologic Age Prefix"],
    "REFERENCES": ["Citation"],
}

# Label sets kept from each source and their canonical spellings.
SOURCE_A_LABELS = [
    "OCEAN ISLAND", "Continental arc", "Island arc", "Intra-oceanic arc", "Back-arc basin",
    "CONTINENTAL FLOOD BASALT", "RIFT VOLCANICS", "OCEANIC PLATEAU",
]
SOURCE_A_RECODE = {"RIFT VOLCANICS": "CONTINENTAL_RIFT", "Back-arc basin": "BACK-ARC_BASIN"}
SOURCE_B_LABELS = [
    "OCEAN ISLAND", "BACK-ARC_BASIN", "CONTINENTAL_RIFT", "OCEANIC PLATEAU", "SPREADING_CENTER",
]
SOURCE_B_RECODE = {
    "OCEAN_ISLAND": "OCEAN ISLAND",
    "OCEANIC_PLATEAU": "OCEANIC PLATEAU",
    "BACK-ARC BASIN": "BACK-ARC_BASIN",
    "CONTINENTAL RIFT": "CONTINENTAL_RIFT",
    "SPREADING CENTER": "SPREADING_CENTER",
}
LABEL_ABBREVIATIONS = {
    "Continental arc": "CA",
    "Island arc": "IA",
    "Intra-oceanic arc": "IOA",
    "BACK-ARC_BASIN": "BAB",
    "SPREADING_CENTER": "MOR",
    "OCEANIC PLATEAU": "OP",
    "OCEAN ISLAND": "OI",
    "CONTINENTAL FLOOD BASALT": "CF",
    "CONTINENTAL_RIFT": "CR",
}
ARC_LABELS = ["Continental arc", "Island arc", "Intra-oceanic arc"]

# Minority labels lifted by oversampling and their target row count.
OVERSAMPLE_TARGETS = {
    "CONTINENTAL_RIFT": 3000,
    "Island arc": 3000,
    "BACK-ARC_BASIN": 3000,
    "Intra-oceanic arc": 3000,
    "OCEANIC PLATEAU": 3000,
}

# Feature groups used to re-sort attribution rankings.
ELEMENT_GROUPS = {
    "LILE": ["RB", "BA", "SR", "K2O"],
    "HFSE": ["TH", "NB", "TA", "ZR", "HF"],
    "REE": ["LA", "CE", "PR", "ND", "SM", "EU", "GD", "TB", "DY", "HO", "ER", "YB", "LU", "Y"],
    "Transition": ["V", "CR", "MNO", "CO", "NI"],
    "Major": ["SIO2", "TIO2", "AL2O3", "FEOT", "MGO", "CAO", "NA2O", "P2O5"],
}

# Column orders of the model input (first and second layout of the grid part and
# of the sequence part), by short feature name.
GRID_ORDER_V1 = [
    "NA2O", "MGO", "CR", "AL2O3", "SIO2", "P2O5", "K2O", "CAO", "TIO2", "V", "MNO", "FEOT",
    "RB", "SR", "Y", "NB", "CO", "NI", "BA", "LA", "CE", "PR", "ND", "ZR",
    "SM", "EU", "GD", "TB", "DY", "HO", "TH", "ER", "YB", "LU", "HF", "TA",
]
GRID_ORDER_V2 = [
    "RB", "BA", "TH", "SR", "K2O", "NA2O", "LA", "CE", "NB", "TA", "PR", "ND",
    "SM", "EU", "ZR", "HF", "GD", "TB", "DY", "HO", "ER", "YB", "LU", "Y",
    "SIO2", "AL2O3", "FEOT", "MGO", "CAO", "TIO2", "CR", "NI", "CO", "V", "MNO", "P2O5",
]
SEQUENCE_ORDER_V1 = [
    "RB", "K2O", "BA", "SR", "CAO", "NA2O", "LA", "Y", "MGO", "PR", "CE", "ER",
    "HO", "ND", "SM", "DY", "LU", "TB", "GD", "YB", "EU", "TH", "AL2O3", "HF",
    "ZR", "TIO2", "MNO", "V", "NB", "CR", "TA", "FEOT", "CO", "NI", "SIO2", "P2O5",
]
SEQUENCE_ORDER_V2 = [
    "RB", "BA", "TH", "K2O", "NA2O", "NB", "TA", "LA", "CE", "PR", "SR", "P2O5",
    "ND", "SM", "ZR", "HF", "EU", "TIO2", "AL2O3", "GD", "TB", "DY",
    "HO", "Y", "ER", "YB", "LU", "CAO", "V", "MNO",
    "FEOT", "MGO", "SIO2", "CR", "NI", "CO",
]

# 95 % quantile of chi-square with two degrees of freedom.
CHI2_95_2DF = 5.9915

# Placeholders and accepted vocabularies.
UNMATCHED_REGION = "GeoROC_unmatched"
FINGERPRINT_NULL = -999999.0
UNIT_STATUSES = ["CRATON", "PROVINCE_OR_SHIELD", "NOT_A_CRATON", "UNKNOWN"]
UNIT_CONFIDENCES = ["high", "medium", "low"]
UNSETTLED_NAMES = ["not a craton", "unknown", "unresolved"]

# Evidence column -> (how many frequent texts, text length kept).
EVIDENCE_SPECS = {
    "source_locations": ("SOURCE_LOCATION", 12, 700),
    "references": ("REFERENCE", 6, 500),
    "rock_names": ("ROCK_NAME", 8, 120),
    "age_texts": ("SOURCE_AGE_TEXT", 5, 200),
    "original_tectonic_labels": ("SOURCE_ORIGINAL_TECTONIC_LABEL", 8, 160),
}
