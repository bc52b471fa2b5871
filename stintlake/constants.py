"""Fixed values of the domain: word lists, lookup tables, physical constants and thresholds."""

# Keys -------------------------------------------------------------------------------------
RACE = ["Year", "GrandPrix"]
SESSION_DRIVER = ["Year", "GrandPrix", "Driver"]
LAP = ["Year", "GrandPrix", "Driver", "LapNumber"]

# Tyre compounds ---------------------------------------------------------------
DRY_COMPOUNDS = ["SOFT", "MEDIUM", "HARD"]
SECOND_COMPOUND = {"SOFT": "HARD", "MEDIUM": "HARD", "HARD": "MEDIUM"}

# Pace -------------------------------------------------------------------------
PACE_LIMIT = 1.07
FUEL_SECONDS_PER_LAP = 0.055

# Prediction grid and pit stops ------------------------------------------------
GRID_TYRES = 60
GRID_LAPS = 80
PIT_LOSS_DEFAULT = 22.0
PIT_LOSS = {
    "monaco_grand_prix": 19.0,
    "singapore_grand_prix": 27.0,
    "british_grand_prix": 22.0,
    "italian_grand_prix": 21.0,
    "belgian_grand_prix": 20.0,
    "australian_grand_prix": 20.0,
    "abu_dhabi_grand_prix": 21.0,
}
STOP_MARGIN_LAPS = 3
MEASURABLE_WEAR = 0.02

# Names of the races where stripping the suffix is not enough -------------------
CIRCUIT_NAMES = {
    "emilia_romagna_grand_prix": "Emilia-Romaña",
    "são_paulo_grand_prix": "São Paulo",
    "united_states_grand_prix": "Estados Unidos",
    "saudi_arabian_grand_prix": "Arabia Saudita",
    "mexico_city_grand_prix": "México",
    "abu_dhabi_grand_prix": "Abu Dhabi",
    "las_vegas_grand_prix": "Las Vegas",
    "british_grand_prix": "Gran Bretaña",
    "japanese_grand_prix": "Japón",
    "chinese_grand_prix": "China",
    "australian_grand_prix": "Australia",
    "bahrain_grand_prix": "Baréin",
    "spanish_grand_prix": "España",
    "austrian_grand_prix": "Austria",
    "hungarian_grand_prix": "Hungría",
    "belgian_grand_prix": "Bélgica",
    "dutch_grand_prix": "Países Bajos",
    "italian_grand_prix": "Italia",
    "azerbaijan_grand_prix": "Azerbaiyán",
    "singapore_grand_prix": "Singapur",
    "canadian_grand_prix": "Canadá",
    "miami_grand_prix": "Miami",
    "monaco_grand_prix": "Mónaco",
    "qatar_grand_prix": "Qatar",
    "barcelona_grand_prix": "Barcelona",
}
NO_TEAM = "Sin equipo"

# Position quality ---------------------------------------------------------------
POSITION_UNITS_PER_METRE = 10
MIN_STEP_M = 0.5
STALLED_RATIO = 0.5
JUMP_RATIO = 1.3
MIN_QUALITY_SAMPLES = 20
POSITION_OK = 0.75

# Derived physics ----------------------------------------------------------------
GRAVITY = 9.81
NEIGHBOUR_BASE_M = 20
COHERENCE_RATIO = 1.15
SMOOTHING_HALF_WIDTH = 3
LATERAL_MAX_G = 5.2
LONGITUDINAL_MIN_G = -6.0
LONGITUDINAL_MAX_G = 2.5
HIGH_LOAD_G = 3
DRS_OPEN_FROM = 10
RPM_MIN = 8000
RPM_MAX = 12000
SHIFT_LIGHTS = 15
WHEEL_DIAMETER_M = 0.72
AERO_REFERENCE_KMH = 300

# Track map ------------------------------------------------------------------------
MAP_WIDTH = 400
MAP_HEIGHT = 320
MAP_PADDING = 26
CUT_TOLERANCE = 1.8
CUT_MINIMUM = 8
PICK_DISTANCE_SQUARED = 140
PICK_CELL = 12

# Columns ----------------------------------------------------------------------------
TELEMETRY_COLUMNS = [
    "Driver", "Team", "LapNumber", "Compound",
    "SessionTime", "Distance", "Speed", "RPM", "nGear", "Throttle", "Brake", "DRS",
    "X", "Y", "DriverAhead", "DistanceToDriverAhead",
]
LAP_COLUMNS = [
    "LapNumber", "Distance", "Speed", "RPM", "nGear", "Throttle", "Brake", "DRS", "X", "Y",
    "Compound",
]
EVENT_TEXT_COLUMNS = [
    "Category", "Message", "Status", "Flag", "Scope", "Sector", "RacingNumber",
]
MODEL_FEATURES = ["TyreLife", "LapNumber", "Stint", "Compound"]
TARGET_LABEL = "delta contra la mejor vuelta del piloto en la carrera"
MODEL_TARGET = "LapTimeDelta"
