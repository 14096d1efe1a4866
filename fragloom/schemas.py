"""Schemas of the tables that the engine reads and writes. Coordinates are always (y, x); absence is NULL, never NaN."""

from __future__ import annotations

POINT = "struct<y:double,x:double>"

#: One decoded picture; data are BGRA or BGR bytes, row by row, as Spark's image source gives them.
IMAGE = "frag_id string, side string, path string, height int, width int, n_channels int, data binary, status string"
CONTOUR = f"frag_id long, image_id int, points array<{POINT}>"
CONTOUR_POINT = "frag_id long, image_id int, k int, y double, x double"
#: A relative position of two fragments: contact points a and b, unit vector of the separation.
POSE = "pair_id long, translation_id int, ay double, ax double, by double, bx double, dy double, dx double"
PATCH_SCORE = "pair_id long, side string, translation_id int, patch_idx int, score float, ty double, tx double, ay double, ax double, by double, bx double"
MERGED_CELL = "pair_id long, iy int, ix int, gy double, gx double, s_recto double, s_verso double, s_sum double, tid_recto int, tid_verso int"
MASK_PX = "image_id string, y int, x int, r smallint, g smallint, b smallint, a smallint"
#: How a pair ended: done, no pose, unreadable or failed.
PAIR_STATUS = "a string, b string, side string, status string, error string"
