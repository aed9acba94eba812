"""Fixed values of the positioning domain.

Everything here is a constant that results depend on: centimetres, seconds,
message patterns and settings bounds.  No logic lives in this module.
"""

# --- fixed values: message patterns (matched against device text) -----------
KEY_VALUE = r"([A-Za-z][A-Za-z0-9_]*)\s*[:=]\s*([^,;\s]+)"
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
ANCHOR_D1 = r"\bA\s*(\d+)\s*(?:D1|DIST|DISTANCE)\s*[:=]\s*(" + NUMBER + ")"
ANCHOR_INDEXED = r"\bA\s*(\d+)\s*[:=]\s*(" + NUMBER + ")"
D_INDEXED = r"\bD\s*(\d+)\s*[:=]\s*(" + NUMBER + ")"
WORD_INDEXED = r"\b(?:DIST|DISTANCE|RANGE|R)\s*([1-9]\d*)\s*[:=]\s*(" + NUMBER + ")"
ID_KEYS = ("anchor", "id", "a")
DISTANCE_KEYS = ("d1", "dist", "distance", "range", "r")
EVENT_KEYS = ("event", "type")
DEFAULT_EVENT = "DISTANCE"
FALSE_FLAGS = ("0", "false", "off", "ko", "invalid", "none", "nan")
TELEMETRY_PREFIX = "UWB,"
TELEMETRY_KEYS = ("session", "src", "dst", "cb", "status", "lastDist", "d1", "ms")
LOG_COLUMNS = (
    "timestamp_iso",
    "timestamp_s",
    "source_ip",
    "source_port",
    "event",
    "anchor_id",
    "distance_cm",
    "raw_message",
    "fields_json",
)

# --- fixed values: device network -------------------------------------------
NO_DISTANCE = 65535
STALE_MS = 1500
TARGET_HZ = 10
SUPERFRAME_MS = 100
UDP_PORT = 4210
SESSION_ANCHORS = (
    ("0x1001", 1, "0x1111"),
    ("0x1002", 2, "0x3333"),
    ("0x1003", 3, "0x4444"),
    ("0x1004", 4, "0x5555"),
)

# --- fixed values: clock and filters ----------------------------------------
TICK_HZ = 60
MAX_AGE_S = 2.0
MAX_ALPHA = 0.999999
TRAIL_POINTS = 220
TRUTH_HISTORY = 480
DELAY_WINDOW_S = 1.2

# --- fixed values: court (cm) -----------------------------------------------
CENTER_X, CENTER_Y = 1250.0, 900.0
COURT_LENGTH, COURT_WIDTH = 2800.0, 1500.0
COURT_LEFT = CENTER_X - COURT_LENGTH / 2
COURT_RIGHT = CENTER_X + COURT_LENGTH / 2
COURT_TOP = CENTER_Y - COURT_WIDTH / 2
COURT_BOTTOM = CENTER_Y + COURT_WIDTH / 2
HOOP_OFFSET = 157.5
CENTER_CIRCLE_R = 180.0
FREE_THROW_R = 180.0
RESTRICTED_R = 125.0
THREE_POINT_R = 675.0
KEY_LENGTH, KEY_WIDTH = 580.0, 490.0
CORNER_THREE = 90.0

# --- fixed values: 3D world box, heights and solver -------------------------
WORLD_X = (-450.0, 2950.0)
WORLD_Y = (-350.0, 2150.0)
WORLD_Z = (0.0, 580.0)
TAG_BASE_Z = 95.0
ANCHOR_Z = 600.0
SOLVER_ITERATIONS = 18
SOLVER_DAMPING = 35.0
SOLVER_STOP_CM = 0.01
SINGULAR = 1e-9

# --- fixed values: player analytics -----------------------------------------
HEAT_COLS, HEAT_ROWS, HEAT_RADIUS = 112, 60, 3
JUMP_CM = 12.0
CMS_TO_KMH = 0.036

# --- fixed values: anchor layouts (x, y[, z]) -------------------------------
LAYOUTS_2D = {
    2: ("2 ancres : ligne", {1: (-320.0, 900.0), 2: (2820.0, 900.0)}),
    3: ("3 ancres : triangle", {1: (-180.0, 1880.0), 2: (1250.0, -220.0), 3: (2680.0, 1880.0)}),
    4: (
        "4 ancres : carre",
        {1: (-250.0, -150.0), 2: (2750.0, -150.0), 3: (2750.0, 1950.0), 4: (-250.0, 1950.0)},
    ),
    5: (
        "5 ancres : carre + pointe haut",
        {
            1: (-250.0, -150.0),
            2: (2750.0, -150.0),
            3: (2750.0, 1950.0),
            4: (-250.0, 1950.0),
            5: (1250.0, -280.0),
        },
    ),
    6: (
        "6 ancres : carre + haut/bas",
        {
            1: (-250.0, -150.0),
            2: (2750.0, -150.0),
            3: (2750.0, 1950.0),
            4: (-250.0, 1950.0),
            5: (1250.0, -280.0),
            6: (1250.0, 2080.0),
        },
    ),
}
LAYOUTS_3D = {
    2: ("2 ancres : ligne", {1: (-250.0, 900.0, 600.0), 2: (2750.0, 900.0, 600.0)}),
    3: (
        "3 ancres : triangle",
        {1: (-250.0, 1950.0, 600.0), 2: (1250.0, -150.0, 600.0), 3: (2750.0, 1950.0, 600.0)},
    ),
    4: (
        "4 ancres : carre 3D",
        {
            1: (-250.0, -150.0, 600.0),
            2: (2750.0, -150.0, 600.0),
            3: (2750.0, 1950.0, 600.0),
            4: (-250.0, 1950.0, 600.0),
        },
    ),
    5: (
        "5 ancres : carre + haut",
        {
            1: (-250.0, -150.0, 600.0),
            2: (2750.0, -150.0, 600.0),
            3: (2750.0, 1950.0, 600.0),
            4: (-250.0, 1950.0, 600.0),
            5: (1250.0, -280.0, 600.0),
        },
    ),
    6: (
        "6 ancres : carre + haut/bas",
        {
            1: (-250.0, -150.0, 600.0),
            2: (2750.0, -150.0, 600.0),
            3: (2750.0, 1950.0, 600.0),
            4: (-250.0, 1950.0, 600.0),
            5: (1250.0, -280.0, 600.0),
            6: (1250.0, 2080.0, 600.0),
        },
    ),
}
# the ground-projected mode uses the 2D coordinates with one shared height
LAYOUTS = {"2d": LAYOUTS_2D, "3d": LAYOUTS_3D, "3d_to_2d": LAYOUTS_2D}

# --- fixed values: settings, name -> (default, low, high) -------------------
SETTINGS_VERSION = 2
SETTINGS = {
    "2d": {
        "active_anchor_count": (4, 2, 6),
        "alpha_dist": (0.12, 0.01, 0.95),
        "alpha_pos": (0.10, 0.01, 0.95),
        "precision_tolerance_cm": (100.0, 1.0, 2000.0),
        "noise_std": (18.0, 0.0, 1000.0),
        "spike_prob": (0.025, 0.0, 1.0),
        "spike_amplitude": (120.0, 0.0, 2000.0),
    },
    "3d": {
        "active_anchor_count": (4, 2, 6),
        "alpha_dist": (0.12, 0.01, 0.95),
        "alpha_pos": (0.08, 0.01, 0.95),
        "precision_tolerance_cm": (90.0, 5.0, 2000.0),
        "noise_ratio": (0.012, 0.0, 0.25),
        "spike_prob": (0.02, 0.0, 1.0),
        "spike_amplitude": (110.0, 0.0, 3000.0),
    },
    "3d_to_2d": {
        "active_anchor_count": (4, 2, 6),
        "anchor_height_cm": (600.0, None, None),
        "tag_base_height_cm": (95.0, None, None),
        "tag_assumed_height_cm": (95.0, None, None),
        "alpha_dist": (0.12, 0.01, 0.95),
        "alpha_pos": (0.10, 0.01, 0.95),
        "precision_tolerance_cm": (100.0, 1.0, 2000.0),
        "noise_std": (18.0, 0.0, 1000.0),
        "spike_prob": (0.025, 0.0, 1.0),
        "spike_amplitude": (120.0, 0.0, 2000.0),
    },
}


def default_settings(mode: str = "2d") -> dict:
    return {name: bounds[0] for name, bounds in SETTINGS[mode].items()}
