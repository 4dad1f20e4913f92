"""Names, labels, defaults and thresholds that results depend on."""

from __future__ import annotations

# Header aliases per manifest role, compared on header_key().
ROLE_ALIASES: dict[str, tuple[str, ...]] = {
    "identifier": (
        "api", "api14", "api_number", "uwi", "well_id", "well_api", "log_api",
    ),
    "path": ("tif_path", "tiff_path", "file_path", "image_path", "log_path"),
    "latitude": ("lat", "latitude", "well_lat", "well_latitude"),
    "longitude": (
        "long", "lon", "lng", "longitude", "well_long", "well_lon", "well_longitude",
    ),
    "depth": (
        "depth", "depth_1", "well_depth", "total_depth", "depth_ft", "depth_feet",
    ),
    "log_top_depth": (
        "depth_1", "log_top", "log_top_depth", "top_depth", "start_depth",
        "interval_top", "from_depth", "depth_from", "available_from",
    ),
    "log_bottom_depth": (
        "depth_2", "log_bottom", "log_bottom_depth", "bottom_depth", "end_depth",
        "interval_bottom", "to_depth", "depth_to", "available_to",
    ),
}

# Manifest path cells that mean "an image exists somewhere else".
PLACEHOLDERS = ("ihs assoc image",)

# Image file extensions.
IMAGE_EXTENSIONS = ("tif", "tiff", "png", "jpg", "jpeg", "bmp", "gif")

# Columns appended to the source columns by an import audit, in order.
AUDIT_COLUMNS = (
    "import_row", "source_identifier", "match_identifier", "source_tif_path",
    "resolved_tif_path", "well_loaded", "row_image_loaded", "load_status",
    "resolution_source", "detail",
)

# Metadata an import carries from manifest rows to files, in order.
METADATA_COLUMNS = ("latitude", "longitude", "log_top_depth", "log_bottom_depth")

# Review ledger columns, in order; METADATA_COLUMNS are optional extras.
LEDGER_COLUMNS = (
    "log_api", "file_link", "has_stamp", "type_of_stamp", "log_types", "notes",
    "reviewed_at", "reviewed_by", "file_path",
)
LEDGER_REQUIRED = (
    "file_link", "file_path", "has_stamp", "type_of_stamp", "notes", "reviewed_at",
)
LEGACY_SUBSET_COLUMNS = ("position", "log_api")

DEFAULT_STAMP_TYPES = ("IHS",)
DEFAULT_LOG_TYPES = (
    "Caliper", "Gamma Ray", "Porosity", "Resistivity deep", "Resistivity medium",
    "Resistivity shallow", "Sonic", "Spontaneous Potential",
)

TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")

# Resolution handling.
DEFAULT_DPI = 400.0
MIN_TAG_DPI = 20.0
PLAUSIBLE_WIDTH_IN = (4.0, 20.0)

# Tile pyramid.
TILE_SIZE = 512
TILE_FORMAT_VERSION = 1

# Radial bands of the date stamp, as fractions of its outer radius.
STAMP_BANDS = {
    "ring": (0.94, 1.04),
    "digits": (0.78, 0.95),
    "gap": (0.62, 0.74),
    "text": (0.30, 0.58),
    "outside": (1.08, 1.16),
}
POLAR_RANGE = (0.25, 1.20)

# Trapezoid knots (zero below, plateau from, plateau to, zero above).
TRAPEZOIDS = {
    "ring": (0.40, 0.70, 1.01, 1.01),
    "contrast": (0.05, 0.30, 1.01, 1.01),
    "digits": (0.06, 0.14, 0.35, 0.55),
    "text": (0.03, 0.08, 0.30, 0.50),
}
# Ratio knots (best at or below, worthless at or above), over the digits density.
RATIOS = {"gap": (0.40, 0.90), "outside": (0.30, 0.85)}
ANGULAR_FULL_SCORE = 0.75

# Weight of each sub-score.
WEIGHTS = {
    "ring": 0.14, "contrast": 0.20, "digits": 0.08, "gap": 0.10, "text": 0.07,
    "outside": 0.16, "angular": 0.25,
}
T_HIT = 0.62
T_MISS = 0.38

# Date stamp detector configuration; lengths are inches.
DATE_STAMP_DEFAULTS = {
    "radius_in_min": 0.55,
    "radius_in_max": 0.85,
    "radius_steps": 7,
    "band_in": 24.0,
    "overlap_in": 2.5,
    "line_run_in": 1.5,
    "min_vote_fraction": 0.22,
    "max_candidates_per_band": None,
    "verify_line_run_in": 0.35,
    "n_theta": 360,
    "n_radius": 56,
    "t_hit": 0.62,
    "t_miss": 0.38,
    "max_per_page": None,
    "match_budget": None,
    "template_npz": None,
}
# Limits for pages read one by one, to be passed where they are wanted; nothing is cut without.
PAGE_BUDGET = {"max_candidates_per_band": 12, "max_per_page": 6, "match_budget": 3}
# Candidates ranked by votes per detection that may be kept.
RANKED_PER_KEPT = 3
WORK_DPI = 100.0

# Below this peak-to-median ratio the projection shows no line direction.
MIN_LINE_STRENGTH = 1.7
