"""Closed dictionaries and thresholds of the diagnosis domain."""

# Names, codes and limits that results must agree on.
LABEL_IDS = {"NORMAL": 0, "ECC10": 1, "ECC20": 2, "DEMAG": 3, "REDUC": 4}
CLASSES = ("NORMAL", "ECC10", "ECC20", "DEMAG", "REDUC")
CLASSES_ALPHABETICAL = ("DEMAG", "ECC10", "ECC20", "NORMAL", "REDUC")
PACK_CLASSES = ("CAUTION", "DEFECT", "NORMAL")
PACK_FAULTS = ("cell_deviation", "cell_voltage", "none")
VEHICLES = ("IONIQ", "KONA", "NIRO")
SENSORS = ("Current_U", "Vib_Motor", "Vib_TM")
SIGNAL_COLUMNS = ("peak_freq_bin", "band_start", "band_end", "rms")
META_COLUMNS = ("group_key", "vehicle", "fault_class", "date", "sensor", "timestamp", "zsplit")
RECORDING_SUFFIX = "_timeseries.csv"
ALLOWED_ROW_COUNTS = (2000, 4000, 6000, 8000, 10000)
CHUNK_ROWS = 2000

PACK_STEPS, PACK_CELLS = 20, 98
PACK_V_MIN, PACK_V_SPAN = 3.0, 1.2
SPECTROGRAM_WIDTH, SPECTROGRAM_HEIGHT = 2000, 1280

PACK_STATUS = {"NORMAL": "normal", "CAUTION": "caution", "DEFECT": "warning"}
ALERT_LEVEL = {
    "normal": "info",
    "caution": "warning",
    "warning": "warning",
    "defect": "critical",
    "critical": "critical",
}
SEVERITY = {"normal": 0, "caution": 1, "warning": 2}
