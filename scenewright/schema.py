"""Table layouts and fixed values."""

from __future__ import annotations

POINT = "struct<x: double, y: double>"
RINGS = f"array<array<{POINT}>>"

ENTITIES = (
    "garden_id string, entity_ord bigint, kind string, layer string, color_index int, true_color int, linetype string, closed boolean,"
    f" cx double, cy double, radius double, points array<{POINT}>"
)
#: rings[0] is the shell, the others are holes; a circle has cx, cy and radius instead.
ELEMENTS = (
    f"garden_id string, elem_ord bigint, id bigint, type string, gtype string, rings {RINGS},"
    " cx double, cy double, radius double, transparent double, weight double, name string, cluster_id bigint"
)
NODES = "garden_id string, node_id bigint, node_ord bigint, x double, y double"
EDGES = f"garden_id string, src bigint, dst bigint, edge_ord bigint, length double, waypoints array<{POINT}>"

# Layer names are matched exactly, upper and lower case differ.
LAYER_CATEGORY = {
    "road": "road",
    "沿岸线": "water",
    "water": "water",
    "archi": "hollow wall",
    "archi-1": "hollow wall",
    "archi 1": "hollow wall",
    "archiw": "solid wall",
    "archi-w": "solid wall",
    "archi w": "solid wall",
    "archive-w": "solid wall",
    "stone": "rockery",
    "rock": "rockery",
    "plant": "vegetation",
}
UNKNOWN_CATEGORY = "unknown"
CATEGORY_VISIBILITY = {"water": True, "solid wall": False, "rockery": False, "hollow wall": True, "vegetation": False}
TYPE_WEIGHT = {"building": 2.0, "rock": 1.5, "plant": 0.65, "water": 1.5}
#: The order of the types in a sector vector, and in structural features.
SECTOR_TYPES = ["building", "rock", "plant", "water"]
STRUCTURE_TYPES = ["water", "rock", "plant", "building"]

UNIT = 1000.0
N_SECTORS, RAYS_PER_SECTOR, RAY_LENGTH, DECAY_DISTANCE, DECAY_RATE = 16, 4, 30.0, 50.0, 3.0
OPAQUE = 1e-5
VIRTUAL_HIT = 0.3
CIRCLE_VERTICES, TOUCH_VERTICES = 128, 64
ROCK_LINK, ROCK_ALPHA, WATER_LINK, WALL_HALF_WIDTH = 1.0, 8.0, 0.5, 0.2
PLANT_EPS, PLANT_MIN_SAMPLES, PLANT_RADIUS_WEIGHT = 8.0, 2, 1.0
OPENNESS_DISTANCE, BLOCK_RATIO = 50.0, 0.3
