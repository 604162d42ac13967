"""Chart structures of one frame by plain loops and numpy, for tests: one function a rule, bars as lists."""

import math
from itertools import pairwise

import numpy as np


def swings(values, distance, least):
    """Places of tops that stand out, as their definition says."""
    n, tops, i = len(values), [], 1
    while i < n - 1:
        end = i
        while end + 1 < n and values[end + 1] == values[i]:
            end += 1
        if values[i - 1] < values[i] and end + 1 < n and values[end + 1] < values[i]:
            tops.append((i + end) // 2)
        i = end + 1
    kept = []
    for p in sorted(tops, key=lambda p: (-values[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def stands(p):
        lows = []
        for step in (-1, 1):
            low, j = values[p], p
            while 0 <= j < n and values[j] <= values[p]:
                low, j = min(low, values[j]), j + step
            lows.append(low)
        return values[p] - max(lows)

    return sorted(p for p in kept if stands(p) >= least)


def fit(xs, ys):
    if len(xs) < 2:
        return 0.0, ys[-1], 0.0
    slope, cut = np.polyfit(xs, ys, 1)
    total = sum((y - np.mean(ys)) ** 2 for y in ys)
    r2 = 1 - sum((y - slope * x - cut) ** 2 for x, y in zip(xs, ys, strict=True)) / total if total else 1.0
    return slope, cut, min(1.0, max(0.0, r2))


class Frame:
    """The rules of one frame; ``found`` collects (pattern, direction, confidence, start, end, confirmed, false_break, level, height)."""

    def __init__(self, bars, start, daily):
        self.o, self.h, self.l, self.c, self.v = ([float(b[k]) for b in bars] for k in ("open", "high", "low", "close", "volume"))
        self.n, self.start, self.daily, self.found = len(bars), start, daily, []
        before = [self.c[0], *self.c[:-1]]
        ranges = [max(h - x, abs(h - p), abs(x - p)) for h, x, p in zip(self.h, self.l, before, strict=True)]
        self.atr = max(np.mean(ranges[-14:]), self.c[-1] * 0.002)
        distance, least = max(3, self.n // 14), max(0.8 * self.atr, 0.12 * np.std(self.c, ddof=1))
        self.peaks, self.troughs = swings(self.h, distance, least), swings([-x for x in self.l], distance, least)
        bodies = [abs(c - o) for c, o in zip(self.c, self.o, strict=True)]
        shadows = [max(h - x - b, 0.0) for h, x, b in zip(self.h, self.l, bodies, strict=True)]
        self.calm_bars = all(b - a <= max(a, 1e-12) * 0.08 for v in (bodies, shadows) for a, b in pairwise(v[-3:]))

    def sure(self, level, up):
        return (self.c[-1] >= level * 1.03 if up else self.c[-1] <= level * 0.97) and (self.calm_bars or not self.daily)

    def broken(self, level, up):
        return self.c[-2] > level >= self.c[-1] if up else self.c[-2] < level <= self.c[-1]

    def add(self, name, direction, confidence, places, sure, broken, level, height):
        self.found.append((name, direction, confidence, self.start + min(places), self.start + max(places), bool(sure), bool(broken), level, height))

    def trend(self, first, top):
        back = min(32, first)
        if back < 6:
            return False
        own = self.c[first - back : first + 1]
        begin = max(abs(np.median(own[:3])), 1e-12)
        move, need = np.median(own[-3:]) / begin - 1, max(0.04, 3 * self.atr / begin)
        slope = fit(range(len(own)), own)[0]
        return move >= need and slope > 0 if top else move <= -need and slope < 0

    def followed(self, prices, neck, top):
        middle = np.mean(prices)
        depth, margin = abs(middle - neck), max(0.35 * self.atr, 0.003 * abs(middle))
        if depth < max(2 * self.atr, 0.025 * abs(middle)):
            return False
        now = self.c[-1]
        return now <= max(prices) + margin and now <= middle - depth / 4 if top else now >= min(prices) - margin and now >= middle + depth / 4

    def multiple(self):
        for top, own, values in ((True, self.peaks, self.h), (False, self.troughs, self.l)):
            suffix, direction = ("top", "bearish") if top else ("bottom", "bullish")
            for n, most, name, base in ((2, 0.06, "double", 0.68), (3, 0.08, "triple", 0.72)):
                if len(own) < n:
                    continue
                chosen = own[-n:]
                prices = [values[p] for p in chosen]
                between = (self.l if top else self.h)[chosen[0] : chosen[-1] + 1]
                neck = min(between) if top else max(between)
                alike = (max(prices) - min(prices)) / max(abs(np.mean(prices)), 1e-12) <= most
                if alike and (n == 3 or chosen[1] - chosen[0] >= 5) and self.trend(chosen[0], top) and self.followed(prices, neck, top):
                    sure = self.sure(neck, not top)
                    self.add(f"{name}_{suffix}", direction, base + 0.12 * sure, chosen, sure, self.broken(neck, not top), neck, abs(np.mean(prices) - neck))

    def heads(self):
        for top in (True, False):
            own, other, values, deep = (self.peaks, self.troughs, self.h, self.l) if top else (self.troughs, self.peaks, self.l, self.h)
            sign = 1 if top else -1
            recent = own[-7:]
            for s in range(len(recent) - 2):
                a, head, b = recent[s : s + 3]
                va, vh, vb = values[a], values[head], values[b]
                shoulders = (va + vb) / 2
                if not self.trend(a, top) or abs(va - vb) / max(abs(shoulders), 1e-12) > 0.10:
                    continue
                if not (vh > max(va, vb) * 1.03 if top else vh < min(va, vb) * 0.97):
                    continue
                left, right = [p for p in other if a < p < head], [p for p in other if head < p < b]
                if not left or not right:
                    continue
                x, y = min(left, key=lambda p: sign * deep[p]), min(right, key=lambda p: sign * deep[p])
                slope = (deep[y] - deep[x]) / (y - x)
                level, height = deep[x] + slope * (self.n - 1 - x), abs(vh - deep[x] - slope * (head - x))
                if height < max(2.5 * self.atr, 0.03 * abs(vh)):
                    continue
                like = [p for p in recent if p != head and abs(values[p] - shoulders) / max(abs(shoulders), 1e-12) <= 0.14]
                compound, sure = len(like) >= 3 or s + 3 < len(recent), self.sure(level, not top)
                name = f"{'compound_' if compound else ''}head_and_shoulders_{'top' if top else 'bottom'}"
                self.add(name, "bearish" if top else "bullish", min(0.96, 0.8 + 0.04 * compound + 0.12 * sure), [a, b], sure, self.broken(level, not top), level, height)

    def flanks(self, at, width):
        left, right = max(0, at - width), min(self.n - 1, at + width)
        return left, right, fit(range(left, at + 1), self.c[left : at + 1]), fit(range(at, right + 1), self.c[at : right + 1])

    def turned(self, at, left, right, bottom):
        least = max(2 * self.atr, abs(self.c[at]) * 0.03)
        return abs(self.c[at] - self.c[left]) >= least and abs(self.c[right] - self.c[at]) >= least

    def turns(self):
        n, whole = self.n, max(self.h) - min(self.l)
        ys = (np.array(self.c) - np.mean(self.c)) / max(np.std(self.c), 1e-12)
        xs = np.arange(n) / (n - 1)
        a, b, c = np.polyfit(xs, ys, 2)
        total = float(((ys - ys.mean()) ** 2).sum())
        r2 = 1 - float(((ys - (a * xs * xs + b * xs + c)) ** 2).sum()) / total if total else 0.0
        turn = -b / (2 * a) if a else 0.5
        at = int(np.clip(round(turn * (n - 1)), 0, n - 1))
        left, right, falls, rises = self.flanks(at, max(6, min(n // 4, 20)))
        bottom = a > 0
        way = falls[0] < 0 < rises[0] if bottom else falls[0] > 0 > rises[0]
        if abs(a) > 0.7 and r2 > 0.55 and 0.2 <= turn <= 0.8 and way and self.turned(at, left, right, bottom) and min(falls[2], rises[2]) >= 0.3:
            level = max(self.c) if bottom else min(self.c)
            self.add(f"rounding_{'bottom' if bottom else 'top'}", "bullish" if bottom else "bearish", min(0.88, 0.55 + 0.3 * r2), [0, n - 1], self.sure(level, bottom), self.broken(level, bottom), level, whole)
        for bottom, values in ((True, self.l), (False, self.h)):
            at = values.index(min(values) if bottom else max(values))
            if not 0.2 * n < at < 0.8 * n:
                continue
            left, right, falls, rises = self.flanks(at, max(8, min(n // 4, 24)))
            reach = max(1.25 * self.atr, 0.015 * abs(values[at]))
            near = [i for i, x in enumerate(values) if (x <= values[at] + reach if bottom else x >= values[at] - reach)]
            once = all(j - i <= 3 for i, j in pairwise(near)) and len(near) <= max(5, n // 12)
            way = falls[0] < 0 < rises[0] if bottom else falls[0] > 0 > rises[0]
            if way and min(falls[2], rises[2]) > 0.55 and once and self.turned(at, left, right, bottom):
                self.add("v_bottom" if bottom else "inverted_v_top", "bullish" if bottom else "bearish", 0.72, [at], True, False, None, whole)
        self.island(whole)

    def island(self, whole):
        up = [i for i in range(1, self.n) if self.l[i] > self.h[i - 1] * 1.001]
        down = [i for i in range(1, self.n) if self.h[i] < self.l[i - 1] * 0.999]
        reach = max(12, self.n // 3)
        pairs = [(a, b, True) for a in up for b in down if a < b <= a + reach] + [(a, b, False) for a in down for b in up if a < b <= a + reach]
        for a, b, top in sorted(pairs, key=lambda p: (-p[1], not p[2], p[0])):
            high, low, after = max(self.h[a:b]), min(self.l[a:b]), self.c[b:]
            if top:
                fine, level = low > max(self.h[a - 1], self.h[b]) * 1.001 and all(c <= high for c in after), low
                strong, outside = any(c <= low * 0.97 for c in after), [c < low for c in after]
            else:
                fine, level = high < min(self.l[a - 1], self.l[b]) * 0.999 and all(c >= low for c in after), high
                strong, outside = any(c >= high * 1.03 for c in after), [c > high for c in after]
            if not fine:
                continue
            three = any(all(outside[i : i + 3]) for i in range(len(outside) - 2))
            sure = strong and len(after) >= 3 and self.calm_bars if self.daily else strong or three
            self.add(f"island_reversal_{'top' if top else 'bottom'}", "bearish" if top else "bullish", 0.84, [a, b], sure, False, level, whole)
            return

    def cups(self):
        n = self.n
        handle = max(6, min(n // 8, 16))
        tail, first = n - handle, max(4, int(n * 0.18))
        last = min(tail - 8, int(n * 0.70))
        if n >= 60 and tail >= int(n * 0.62) and last > first:
            head = self.h[: max(12, int(n * 0.38))]
            left, bottom = head.index(max(head)), first + self.l[first:last].index(min(self.l[first:last]))
            right = self.h[bottom + 4 : tail]
            if len(right) >= 8:
                self.cup(left, bottom, bottom + 4 + right.index(max(right)), handle)
        start = max(12, int(n * 0.45))
        end = min(max(start + 20, n - max(5, n // 10)), n)
        if n >= 48 and end - start >= 20:
            own, prior, high, low = self.c[start:end], self.c[:start], max(self.h[start:end]), min(self.l[start:end])
            was, volume = np.std(prior), np.median(self.v[:start])
            quiet = high - low <= max(7 * self.atr, 0.12 * max(np.mean(own), 1e-12)) and (was <= 0 or np.std(own) <= 0.8 * was)
            if prior[-1] / prior[0] - 1 <= -0.08 and quiet and (volume <= 0 or np.median(self.v[start:end]) <= 0.95 * volume):
                sure = self.sure(high, True)
                places = sorted(range(start, end), key=lambda i: (self.h[i], i))[-2:] + sorted(range(start, end), key=lambda i: (self.l[i], i))[:2]
                self.add("dormant_bottom", "bullish" if sure else "neutral", 0.58 + 0.12 * sure, places, sure, self.broken(high, True), high, high - low)

    def cup(self, left, bottom, right, handle):
        a, b, deep, n = self.h[left], self.h[right], self.l[bottom], self.n
        rim = (a + b) / 2
        if rim - deep < 2 * self.atr or abs(a - b) > max(1.5 * self.atr, 0.12 * rim) or deep >= min(a, b) - self.atr or right - left + 1 < 12:
            return
        out = [i for i in range(right + 1, n) if self.c[i] > rim + max(0.01 * rim, 0.5 * self.atr)]
        end = out[0] if out and out[0] >= right + 4 else n
        start = max(end - handle, right + 1)
        if end - start < 3:
            return
        slope = fit(range(end - start), self.c[start:end])[0]
        if min(self.l[start:end]) < rim - (rim - deep) / 2 or max(self.h[start:end]) > rim + max(0.75 * self.atr, 0.015 * rim) or slope > 0.25 * self.atr:
            return
        sure = self.sure(rim, True)
        self.add("cup_with_handle", "bullish", 0.64 + 0.08 * sure, [left, start, right, bottom], sure, self.broken(rim, True), rim, rim - deep)

    def bounded(self):
        if len(self.peaks) < 2 or len(self.troughs) < 2:
            return
        p, t, n, atr = self.peaks[-4:], self.troughs[-4:], self.n, self.atr
        (a, a0, ar), (b, b0, br) = fit(p, [self.h[i] for i in p]), fit(t, [self.l[i] for i in t])
        upper, lower = (lambda x: a * x + a0), (lambda x: b * x + b0)
        start, end = min(p[0], t[0]), max(p[-1], t[-1])
        wide, narrow = upper(start) - lower(start), upper(end) - lower(end)
        moves = abs(a) * max(1, p[-1] - p[0]), abs(b) * max(1, t[-1] - t[0])
        middle = np.mean(self.c)
        flat, slanted = max(0.75 * atr, 0.015 * middle), max(1.25 * atr, 0.018 * middle)
        off = max(np.mean([abs(self.h[i] - upper(i)) for i in p]), np.mean([abs(self.l[i] - lower(i)) for i in t])) / atr
        sides = sorted([(i, 0) for i in p] + [(i, 1) for i in t])
        waves = sum(x[1] != y[1] for x, y in pairwise(sides))
        triangle = min(len(p), len(t)) >= 3 and waves >= 5 and end - start >= 20 and wide >= 3 * atr and narrow > 0 and off <= 1.25
        box = waves >= 3 and end - start >= 12 and wide >= 2 * atr and narrow > 0 and off <= 1
        up_flat, low_flat, shut = moves[0] <= flat, moves[1] <= flat, narrow < wide
        leaning = triangle and not up_flat and not low_flat
        name = way = None
        if triangle and up_flat and not low_flat and b > 0 and moves[1] >= slanted and br >= 0.35 and narrow <= 0.9 * wide:
            name, way = "ascending_triangle", True
        elif triangle and low_flat and not up_flat and a < 0 and moves[0] >= slanted and ar >= 0.35 and narrow <= 0.9 * wide:
            name, way = "descending_triangle", False
        elif leaning and a < 0 < b and shut and (wide - narrow) / max(abs(wide), atr) >= 0.1:
            name, way = "symmetrical_triangle", True if self.c[-1] > upper(n - 1) else False if self.c[-1] < lower(n - 1) else None
        elif leaning and a > 0 and b > 0 and shut:
            name, way = "rising_wedge", False
        elif leaning and a < 0 and b < 0 and shut:
            name, way = "falling_wedge", True
        elif box and up_flat and low_flat:
            name = "rectangle"
        elif triangle and narrow > 1.25 * wide:
            name, way = "broadening_triangle", False
        if name:
            now, above, below = self.c[-1], upper(n - 1), lower(n - 1)
            if way is None:
                sure, broken = now > above + max(atr / 2, above * 0.01) or now < below - max(atr / 2, below * 0.01), False
                way = now > above if sure else None
                level = above if way else below
            else:
                level = above if way else below
                sure, broken = self.sure(level, way), self.broken(level, way)
            direction = "neutral" if way is None else "bullish" if way else "bearish"
            self.add(name, direction, 0.56 + 0.16 * min(ar, br) + 0.1 * sure, p + t, sure, broken, level, max(wide, narrow))
        impulse_end = max(5, n // 4)
        impulse = self.c[impulse_end] - self.c[0]
        slope, _, r2 = fit(range(n - impulse_end), self.c[impulse_end:])
        against = slope <= 0 if impulse > 0 else slope >= 0
        if abs(impulse) >= 4 * atr and r2 >= 0.25 and against and abs(slope) < abs(impulse) / n:
            up = impulse > 0
            level = max(self.h[impulse_end:]) if up else min(self.l[impulse_end:])
            sure = self.sure(level, up)
            self.add("ascending_flag" if up else "descending_flag", "bullish" if up else "bearish", 0.66 + 0.12 * sure, p + t, sure, self.broken(level, up), level, abs(impulse))

    def all(self):
        for rule in (self.multiple, self.heads, self.turns, self.cups, self.bounded):
            rule()
        return self.found


def frames(bars, lengths=(30, 45, 60, 80, 100), most=120, least=30):
    """(start, bars) of the frames that end with the last of ``bars``."""
    for n in sorted({*lengths, min(len(bars), most)}):
        if least <= n <= len(bars):
            yield len(bars) - n, bars[-n:]


def rounded(row):
    return tuple(round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x for x in map(plain, row))


def plain(x):
    return float(x) if isinstance(x, np.floating) else x
