"""Parameters and tables that results depend on."""

SCHEMA_VERSION, ALGORITHM_VERSION, MATCHER_VERSION, KEY_SCORER_VERSION = 2, 13, 3, 4
TEMPO_SOURCE = "pulsegrid/onset-autocorrelation-comb@5"

# Onset envelope.
ONSET_WINDOW, N_MELS, MEL_LOW, MEL_HIGH = 0.046, 64, 30.0, 11000.0
LOG_GAIN, WHITEN_SECS, WHITEN_FLOOR, KICK_HZ, DETREND_SECS = 10.0, 3.0, 0.01, 120.0, 1.5

# Tempo search, comb scoring and confidence.
LOW_BPM, HIGH_BPM, SEARCH_LOW, SEARCH_HIGH = 90.0, 180.0, 45.0, 280.0
PRIOR_BPM, PRIOR_OCTAVES, ACF_PEAKS, FINALISTS = 128.0, 0.9, 10, 6
RATIOS = (1.0, 3 / 2, 2 / 3, 4 / 3, 3 / 4)
REFINE_SPAN, REFINE_DRIFT, SMOOTH_SECS, PRECISION_SPAN, PRECISION_DRIFT = 0.04, 1 / 16, 0.030, 0.005, 0.2
CONSISTENCY, MISS, LATTICE, HALF_WIDTH_SECS = 1.0, 3.0, (1, 2, 4), 0.030
KICK_RISE_SECS, KICK_LEAD, KICK_LAG, KICK_SHARE, KICK_LEAST = 0.046, 0.2, 0.05, 0.5, 0.015
PERIODIC_AT, CLEAR_AT, MARGIN_AT, COVERED_AT = 0.5, 2.5, 1.0, 32.0
UNCERTAIN = 0.5

# Chroma, key gates and band front end.
CHROMA_WINDOW, CHROMA_LOW, CHROMA_HIGH, BAND_WINDOW = 0.185, 110.0, 3520.0, 16384 / 44100
KEY_FLOOR, KEY_FULL, KEY_MARGIN, SALIENCE_FLOOR, SALIENCE_FULL = 0.45, 0.85, 0.10, 0.02, 0.10
CHROMA_SECS, COVER_FLOOR, COVER_FULL, BAND_COVER_FLOOR, BAND_COVER_FULL = 1.5, 3.5, 5.5, 3.0, 4.0
BANDS = ((24, 36), (36, 48), (48, 60), (60, 72), (72, 96))
GRID_STEP, GRID_LOW, GRID_BINS, GRID_GAIN, GRID_WHITEN = 3, 24.0, 252, 100.0, 18
PITCHES = ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
# Spellings of each pitch class.
SPELLINGS = {"c": 0, "b#": 0, "c#": 1, "db": 1, "d": 2, "d#": 3, "eb": 3, "e": 4, "fb": 4, "f": 5, "e#": 5, "f#": 6, "gb": 6, "g": 7, "g#": 8, "ab": 8, "a": 9, "a#": 10, "bb": 10, "b": 11, "cb": 11}
# Correlation profiles, major and minor.
PROFILES = {
    "krumhansl": ((6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88), (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)),
    "edm": ((6.6, 2.0, 3.5, 2.3, 4.6, 4.0, 2.5, 5.2, 2.4, 3.7, 2.3, 3.4), (6.5, 2.7, 3.5, 5.4, 2.6, 3.5, 2.5, 5.2, 4.0, 2.7, 4.3, 3.2)),
}
# Learned weights by mode, register and scale degree; additive bias by mode.
MODE_BIAS = (-0.5764, 0.5764)
BAND_WEIGHTS = (
    (
        (0.2918, 0.1313, -0.1276, -0.0642, -0.0146, -0.1637, -0.1916, -0.1547, -0.2191, -0.1795, -0.0977, 0.1416),
        (1.1740, 0.0659, -0.2831, -0.3748, -0.0300, -0.1237, -0.0849, 0.4064, -0.1126, -0.2202, -0.4192, -0.0734),
        (1.3093, -0.2948, -0.1640, -0.5345, 0.2167, -0.1494, -0.2955, 0.7815, -0.3776, -0.1596, -0.3921, -0.0228),
        (1.4386, -0.4536, 0.0677, -0.5875, 0.9682, -0.1963, -0.5346, 1.0351, -0.5518, -0.0152, -0.4423, 0.0489),
        (1.2288, -0.6905, 0.4006, -0.8662, 1.0541, -0.3537, -0.4029, 0.8959, -0.7033, -0.2243, -0.6178, 0.3064),
    ),
    (
        (0.5055, 0.2078, -0.1490, 0.0415, -0.0120, -0.0353, 0.0457, -0.0784, -0.1177, -0.0801, -0.0963, 0.4159),
        (1.4589, 0.1718, -0.4197, -0.0438, -0.4489, -0.5337, -0.2226, 0.2954, -0.2864, -0.4084, 0.1145, 0.3985),
        (1.1031, -0.4147, -0.3324, 0.2297, 0.2577, -0.5309, -0.5575, 1.2045, -0.2313, -0.6047, 0.2471, -0.2880),
        (1.4024, -0.4719, -0.0163, 0.4016, -0.0782, -0.5155, -0.4598, 0.9336, -0.6086, -0.9766, 0.2381, -0.6261),
        (1.2787, -0.2698, 0.4715, 0.6750, -0.3180, -0.4018, -0.6615, 1.1574, -0.8065, -0.8560, 0.2899, -0.5863),
    ),
)

# Matching.
SEARCH_LIMIT, MATCH_SURE, TITLE_WEIGHT, QUALIFIER_WEIGHT, INEXACT, CREDIT_FLOOR = 12, 0.85, 0.65, 0.25, 0.97, 0.9
CREDIT_WORDS = ("feat", "featuring", "ft", "with")
NEUTRAL = ("original mix", "album version", "single version", "radio edit", "radio mix", "remastered", "remaster", "explicit", "clean", "bonus track", "deluxe edition", "deluxe", "mono", "stereo")

# Limits.
MAX_AUDIO_BYTES, MAX_SEARCH_BYTES, MAX_SECS, SILENT, PER_MINUTE, BURST, BPM_NEAR = 8 << 20, 1 << 20, 120, 0.001, 18.0, 5.0, 2.0
MAX_REDIRECTS, FETCH_SECS, DEFAULT_MARKET = 2, 30, "us"
ERROR_KINDS = ("invalid_input", "no_match", "not_found", "no_preview", "http", "decode", "unusable_audio", "cache", "internal")

# Tracks of known tempo (and key, where known) that a validation run measures.
REFERENCE_TRACKS = (
    ("Robin S", "Show Me Love", 120.0, "", "house"),
    ("Daft Punk", "Around the World", 121.0, "", "house"),
    ("Stardust", "Music Sounds Better with You", 125.0, "", "house"),
    ("Eric Prydz", "Call on Me", 126.0, "", "house"),
    ("The Chemical Brothers", "Hey Boy Hey Girl", 127.0, "D", "big beat / techno"),
    ("Darude", "Sandstorm", 136.0, "B", "trance"),
    ("Underworld", "Born Slippy .NUXX", 140.0, "Bb", "techno"),
    ("Roni Size / Reprazent", "Brown Paper Bag", 170.0, "", "drum & bass"),
    ("Goldie", "Inner City Life", 155.0, "", "drum & bass"),
    ("Pendulum", "Tarantula", 174.0, "", "drum & bass"),
)
