"""Array kernels on whole pictures: masks are boolean [H, W], pictures uint8 [H, W, 4]."""

from __future__ import annotations

import numpy as np


def shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """mask moved by (dy, dx); what comes in is False."""
    out = np.zeros_like(mask)
    h, w = mask.shape[:2]
    if abs(dy) < h and abs(dx) < w:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def dilate(mask: np.ndarray, offsets=CROSS) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, *o) for o in offsets])


def erode(mask: np.ndarray, offsets=CROSS) -> np.ndarray:
    """Pixels whose neighbours are all set; beyond the border counts as set."""
    return ~dilate(~mask, [(-a, -b) for a, b in offsets])


def closing(mask: np.ndarray) -> np.ndarray:
    return erode(dilate(mask))


def opening(mask: np.ndarray) -> np.ndarray:
    return dilate(erode(mask, SQUARE), SQUARE)


def erode_square(mask: np.ndarray, k: int) -> np.ndarray:
    """Smallest value in the square of 2k+1, values beyond the border left out."""
    out = mask
    for axis in (0, 1):
        n = out.shape[axis]
        parts = [np.take(out, np.clip(np.arange(n) + d, 0, n - 1), axis=axis) for d in range(-k, k + 1)]
        out = np.minimum.reduce(parts)
    return out


def label_points(y: np.ndarray, x: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Component number of each set pixel given by its coordinates, by union of horizontal runs."""
    if not len(y):
        return np.zeros(0, np.int64)
    order = np.lexsort((x, y))
    ys, xs = y[order].astype(np.int64), x[order].astype(np.int64)
    new = np.ones(len(ys), bool)
    new[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(ys)) - 1
    row, lo, hi = ys[start], xs[start], xs[end]
    reach = 1 if connectivity == 8 else 0
    width = xs.max() - xs.min() + 3
    code = lambda r, c: (r - ys.min()) * width + (c - xs.min() + 1)
    # runs of the row below that touch a run form a range, the runs being sorted
    first = np.searchsorted(code(row, hi), code(row + 1, lo - reach), side="left")
    last = np.searchsorted(code(row, lo), code(row + 1, hi + reach), side="right")
    parent = np.arange(len(start))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(start)):
        for j in range(first[i], last[i]):
            if row[j] == row[i] + 1:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(start))])
    out = np.empty(len(ys), np.int64)
    out[order] = np.unique(root, return_inverse=True)[1][run]
    return out


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """0 for the background, 1.. for the components in reading order."""
    out = np.zeros(mask.shape, np.int64)
    y, x = np.nonzero(mask)
    out[y, x] = label_points(y, x, connectivity) + 1
    return out


def largest_component(mask: np.ndarray) -> np.ndarray:
    lab = label(mask)
    n = np.bincount(lab.ravel())
    n[0] = 0
    return lab == n.argmax() if n.max(initial=0) else mask & False


def fill_small_holes(mask: np.ndarray, area: int) -> np.ndarray:
    """Set the background components smaller than ``area``."""
    lab = label(~mask, 4)
    n = np.bincount(lab.ravel())
    small = n < area
    small[0] = False
    return mask | small[lab]


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Closed or open lines (y, x) half way between set and unset pixels: a square of four pixels holds at most two segments.

    Where two set pixels meet at a corner only, they are kept apart.
    """
    m = mask.astype(bool)
    following: dict[tuple[float, float], list[tuple[float, float]]] = {}
    corners = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, 1:] + 8 * m[1:, :-1]
    # ends of a segment: the middles of the square's sides (top, right, bottom, left), set pixels on the right hand
    top, right, bottom, left = (0, 0.5), (0.5, 1), (1, 0.5), (0.5, 0)
    table = {1: [(top, left)], 2: [(right, top)], 3: [(right, left)], 4: [(bottom, right)], 5: [(top, left), (bottom, right)], 6: [(bottom, top)], 7: [(bottom, left)], 8: [(left, bottom)], 9: [(top, bottom)], 10: [(right, top), (left, bottom)], 11: [(right, bottom)], 12: [(left, right)], 13: [(top, right)], 14: [(left, top)]}
    for y, x in zip(*np.nonzero((corners > 0) & (corners < 15))):
        for a, b in table[int(corners[y, x])]:
            following.setdefault((y + a[0], x + a[1]), []).append((y + b[0], x + b[1]))
    ends = {e for v in following.values() for e in v}
    lines = []
    for at in sorted(following, key=lambda p: (p in ends, p)):  # open lines first, from their starts
        while following.get(at):
            line, p = [at], at
            while following.get(p):
                p = following[p].pop(0)
                line.append(p)
            lines.append(np.array(line, float))
    return lines


def contour_from_alpha(alpha: np.ndarray, pad: int = 10, hole_area: int = 1000) -> np.ndarray:
    """The longest outline (y, x) of the largest opaque piece; empty if there is none."""
    mask = np.pad(alpha > 0, pad)
    piece = fill_small_holes(largest_component(closing(mask)), hole_area)
    lines = outlines(piece)
    return max(lines, key=len) - pad if lines else np.zeros((0, 2))


def crop_opaque(picture: np.ndarray, least: int = 250) -> np.ndarray | None:
    """The picture cut to its opaque pixels, single ones left out; None if there are none, unchanged without an alpha channel."""
    if picture.ndim < 3 or picture.shape[2] != 4:
        return picture
    y, x = np.nonzero(opening(picture[:, :, 3] > least))
    return picture[y.min() : y.max() + 1, x.min() : x.max() + 1] if len(y) else None


def blit_slices(t: tuple[float, float], src: tuple[int, int], dst: tuple[int, int]):
    """Slices of the source and of the target when the source is put at floor(t); None if nothing is left."""
    at = [int(np.floor(v)) for v in t]
    s = [(max(0, -o), min(n, m - o)) for o, n, m in zip(at, src, dst)]
    d = [(max(0, o), min(m, o + n)) for o, n, m in zip(at, src, dst)]
    if any(a >= b for a, b in s + d):
        return None
    return tuple(slice(*v) for v in s), tuple(slice(*v) for v in d)


def put(canvas: np.ndarray, picture: np.ndarray, t: tuple[float, float]) -> np.ndarray:
    """Alpha composite: opaque pixels of the picture replace the canvas."""
    cut = blit_slices(t, picture.shape, canvas.shape)
    if cut:
        src, dst = picture[cut[0]], canvas[cut[1]]
        dst[src[..., 3] > 0] = src[src[..., 3] > 0]
    return canvas


def patch(a: np.ndarray, b: np.ndarray, ta: tuple[float, float], tb: tuple[float, float], side: int, soft: float | None = None, combine: str = "sum") -> np.ndarray:
    """A side x side cut of both pictures at their offsets. With ``soft`` alpha is that times each mask, joined by sum or max. Colours are 0 where alpha is."""
    canvas = np.zeros((side, side, 4), np.uint8)
    masks = []
    for picture, t in ((a, ta), (b, tb)):
        own = put(np.zeros_like(canvas), picture, t)
        masks.append((own[..., 3] > 0).astype(np.float32))
        canvas = np.where(own[..., 3:] > 0, own, canvas)
    if soft is not None:
        alpha = soft * masks[0] + soft * masks[1] if combine == "sum" else np.maximum(soft * masks[0], soft * masks[1])
        canvas[..., 3] = np.clip(alpha, 0, 255).astype(np.uint8)
    canvas[canvas[..., 3] == 0] = 0
    return canvas


def fill_polygon(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centres lie in the polygon (y, x), even-odd, clipped to the shape."""
    out = np.zeros(shape, bool)
    a, b = points, np.roll(points, -1, axis=0)
    for y in range(max(0, int(np.ceil(points[:, 0].min()))), min(shape[0], int(np.floor(points[:, 0].max())) + 1)):
        e = (a[:, 0] <= y) != (b[:, 0] <= y)
        cuts = np.sort(a[e, 1] + (y - a[e, 0]) / (b[e, 0] - a[e, 0]) * (b[e, 1] - a[e, 1]))
        for lo, hi in zip(cuts[0::2], cuts[1::2]):
            out[y, max(0, int(np.ceil(lo))) : max(0, int(np.floor(hi)) + 1)] = True
    return out


def gather(src: np.ndarray, mask: np.ndarray, t: tuple[float, float], pedantic: bool = True) -> np.ndarray:
    """Pixels of the mask taken from src at int(index - t). Outside src: left out, or wrapped as numpy does if not pedantic."""
    out = np.zeros((*mask.shape, src.shape[2]), src.dtype)
    y, x = np.nonzero(mask)
    sy, sx = (y - t[0]).astype(int), (x - t[1]).astype(int)
    if pedantic:
        ok = (sy >= 0) & (sx >= 0) & (sy < src.shape[0]) & (sx < src.shape[1])
        y, x, sy, sx = y[ok], x[ok], sy[ok], sx[ok]
    out[y, x] = src[sy, sx]
    return out


def resize(picture: np.ndarray, side: int) -> np.ndarray:
    """float32 [C, side, side] in 0..1: a separable triangle filter, widened when shrinking."""
    out = picture.astype(np.float32) / 255

    def weights(n: int) -> np.ndarray:
        scale = max(n / side, 1.0)
        centre = (np.arange(side) + 0.5) * n / side - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / scale)
        return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)

    return np.einsum("ay,yxc,bx->cab", weights(out.shape[0]), out, weights(out.shape[1]), optimize=True)


def eroded_mask(mask: np.ndarray, size: int) -> np.ndarray:
    """The mask without what lies within ``size`` pixels of its border, by squares; the picture's own border does not count as one."""
    out = mask.copy()
    for axis in (0, 1):
        held = out.copy()
        for k in range(1, size + 1):
            for step in (k, -k):
                moved = np.roll(held, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = slice(0, k) if step > 0 else slice(-k, None)
                moved[tuple(edge)] = True
                out &= moved
    return out


def shift_texture(picture: np.ndarray, dy: float, dx: float, fill: bool = False) -> np.ndarray:
    """The picture moved by a fraction of pixels, bilinear, clamped at the border; with ``fill`` what comes in from outside is transparent black."""
    h, w = picture.shape[:2]
    y, x = np.clip(np.arange(h) - dy, 0, h - 1), np.clip(np.arange(w) - dx, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = picture.astype(np.float32)
    mixed = p[y0][:, x0] * (1 - fy) * (1 - fx) + p[y0][:, x1] * (1 - fy) * fx + p[y1][:, x0] * fy * (1 - fx) + p[y1][:, x1] * fy * fx
    out = np.round(mixed).astype(picture.dtype)
    if fill:
        out[(np.arange(h) - dy < 0) | (np.arange(h) - dy > h - 1)] = 0
        out[:, (np.arange(w) - dx < 0) | (np.arange(w) - dx > w - 1)] = 0
    return out


def uniform(seed: str) -> float:
    """A number in [0, 1) that depends on the key alone, not on the order of work."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=7).digest(), "big") / (1 << 56)


def augment(picture: np.ndarray, key: str, flip: float = 0.5, grey: float = 0.2, posterize: float = 0.2) -> np.ndarray:
    """Random changes of the colours alone (posterize to 4 bits, grey, brightness, contrast, saturation), then flips; alpha stays. No JPEG step: no codec is at hand."""
    u = lambda what: uniform(f"{key}/{what}")
    rgb, alpha = picture[..., :3].astype(np.float32), picture[..., 3:]
    if u("posterize") < posterize:
        rgb = np.floor(rgb / 16) * 16
    if u("grey") < grey:
        rgb = np.repeat((rgb @ np.array([0.299, 0.587, 0.114], np.float32))[..., None], 3, axis=2)
    rgb = rgb * (0.5 + u("brightness"))
    rgb = (rgb - rgb.mean()) * (0.5 + u("contrast")) + rgb.mean()
    luma = rgb @ np.array([0.299, 0.587, 0.114], np.float32)
    rgb = luma[..., None] + (rgb - luma[..., None]) * (0.7 + 0.6 * u("saturation"))
    out = np.concatenate([np.clip(rgb, 0, 255).astype(np.uint8), alpha], axis=2)
    if u("vertical") < flip:
        out = out[::-1]
    return out[:, ::-1] if u("horizontal") < flip else out
