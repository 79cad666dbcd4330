"""Fixed values of the pipeline: thresholds that results depend on."""

# Fixed values.
ALPHA_T = 10  # alpha at or below this is empty
CHROMA_IN, CHROMA_OUT = 24.0, 72.0  # chroma distance of full transparency and of full opacity
DESPILL_BAND, DESPILL_SCALE = 100.0, 0.92
FLOOD_TOL = 88.0
EDGE_MARGIN, EDGE_MAX = 2, 24
KEY_DIST, KEY_MAX = 70.0, 120
SMALL_RATIO, LARGE_RATIO = 0.35, 2.75
MIN_CONTENT, MIN_CONTENT_SHARE = 400, 0.25
DRIFT_WARN, DRIFT_ERROR = 0.65, 0.45
BASE_WARN, BASE_ERROR = 0.60, 0.40
RUN_EPS, RUN_PEAK, RUN_MASS = 0.045, 0.18, 0.20
PEAK_SHARE, VALLEY_SHARE, WIDE_RATIO = 0.45, 0.62, 1.45
CUT_LAMBDA, CUT_MIN_SHARE = 0.0015, 0.45
BODY_SHARE = 0.80
NEAR_CHANNEL = 12
MUCH_SEEN, MUCH_RESIDUE, SEEN_LESS, LITTLE_SEEN = 0.60, 0.025, 0.03, 0.02  # shares of pixels that make another key worth a try
MAGENTA = (255, 0, 255)
