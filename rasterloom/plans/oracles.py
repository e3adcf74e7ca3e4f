"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from rasterloom import fixed_values as fixed
from rasterloom.plans.fixtures import HEIGHT, TEMPLATES, WIDTH

# expectations written out, not computed by the code they check
PRESET = [(0, 69), (70, 85), (86, 130), (131, 145), (146, 216), (217, 255)]
EQUAL = {
    6: [(0, 41), (42, 84), (85, 127), (128, 169), (170, 212), (213, 255)],
    7: [(0, 35), (36, 72), (73, 108), (109, 145), (146, 181), (182, 218), (219, 255)],
    9: [(0, 27), (28, 55), (56, 84), (85, 112), (113, 141), (142, 169), (170, 198), (199, 226), (227, 255)],
}
PRESET_NAMES = [
    "Shadows", "Dark Trees / Forest", "Buildings / Rooftops", "Bare Soil / Ground", "Grass / Lawn", "Buildings / Rooftops",
]
NAMES = [
    "Shadows", "Dark Trees / Forest", "Roads / Pathways", "Bare Soil / Ground", "Grass / Lawn", "Buildings / Rooftops",
    "Parking / Open Area", "Urban / Mixed", "Water Body",
]
PRESET_COLOURS = [(0, 0, 0), (0, 180, 0), (128, 128, 128), (100, 200, 0), (180, 180, 180), (255, 255, 255)]
# hues of 255 * cluster / clusters degrees at saturation 180 and value 220
COLOURS = {
    7: [(220, 64, 64), (220, 158, 64), (189, 220, 64), (93, 220, 64), (64, 220, 129), (64, 215, 220), (64, 122, 220)],
    9: [(220, 64, 64), (220, 137, 64), (220, 210, 64), (155, 220, 64), (83, 220, 64), (64, 220, 119), (64, 220, 194), (64, 174, 220), (64, 101, 220)],
}
DIMS = {
    6: (PRESET, PRESET_NAMES, PRESET_COLOURS),
    7: (EQUAL[7], NAMES[:7], COLOURS[7]),
    9: (EQUAL[9], NAMES, COLOURS[9]),
}


def _level(e: str) -> str:
    return (
        f"CAST(LEAST(255, GREATEST(0, FLOOR((CAST({e} AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE * 256))) AS INT)"
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


R1 = f"""r1 AS MATERIALIZED (
  SELECT vec_id // 100 AS image_id, CAST(vec_id % 100 AS INT) AS y, CAST(i - 1 AS INT) AS x,
         {_level('embedding[i]')} AS v
  FROM embeddings, range(1, {WIDTH + 1}) AS t(i))"""

R2 = f"""r2 AS MATERIALIZED (
  SELECT vec_id // 100 AS image_id, CAST(vec_id % 100 AS INT) AS y, CAST(p AS INT) AS x,
         {_level('embedding[p + 1]')} AS b,
         {_level('embedding[(p + 21) % 64 + 1]')} AS g,
         {_level('embedding[(p + 42) % 64 + 1]')} AS r,
         CAST((vec_id * 7 + p * 13) % 256 AS INT) AS a
  FROM embeddings, range(0, {WIDTH}) AS t(p))"""

R3 = """r3 AS (
  SELECT l_suppkey AS image_id, CAST(l_quantity AS INT) * 5 AS b, CAST(ROUND(l_discount * 100) AS INT) * 25 AS g,
         CAST(FLOOR(l_extendedprice / 105000 * 256) AS INT) AS r
  FROM lineitem)"""

E1 = """e1 AS (
  SELECT user_id, event_id, (user_id + event_id // 3) % 5 AS image_id, CAST(event_id % 70 AS INT) AS x,
         CAST((event_id // 70) % 105 AS INT) AS y,
         CASE event_type WHEN 'view' THEN 'mm' WHEN 'signup' THEN 'cm' WHEN 'purchase' THEN 'inches'
              ELSE 'pixels' END AS unit,
         CAST(1 + event_id % 10 AS INT) AS ppu
  FROM events)"""

G1 = """g1 AS (
  SELECT concat('N-', n_nationkey) AS code, lower(n_name) AS alias, 33 + n_nationkey * 0.05::DOUBLE AS lat,
         72.5::DOUBLE + n_regionkey * 0.2::DOUBLE AS lon
  FROM nation)"""

G2 = """g2 AS (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('N-', c_nationkey)
         WHEN 1 THEN concat('  n-', c_nationkey, ' ') WHEN 2 THEN concat('NATION_', c_nationkey)
         ELSE 'Atlantis' END AS name
  FROM customer)"""

RESOLVED = """resolved AS (
  SELECT g2.*, coalesce(c.code, a.code) AS code, coalesce(c.lat, a.lat) AS lat, coalesce(c.lon, a.lon) AS lon
  FROM g2 LEFT JOIN g1 c ON c.code = upper(trim(g2.name)) LEFT JOIN g1 a ON a.alias = lower(trim(g2.name)))"""


def _boxed(source: str) -> str:
    half = f"({fixed.SECTOR_METRES} / 2)::DOUBLE"
    lon = f"{half} / ({fixed.METRES_PER_DEGREE} * cos(radians(lat)))"
    lat = f"{half} / {fixed.METRES_PER_DEGREE}"
    return (
        f"boxed AS (SELECT *, lon - {lon} AS west, lat - {lat} AS south, lon + {lon} AS east, lat + {lat} AS north"
        f" FROM {source})"
    )


LUMA = "((b * {} + g * {} + r * {} + {}) >> {})".format(
    *fixed.LUMA_WEIGHTS, 1 << (fixed.LUMA_SHIFT - 1), fixed.LUMA_SHIFT
)

HIST = "hist AS MATERIALIZED (SELECT image_id, v, count(*)::BIGINT AS n FROM r1 GROUP BY 1, 2)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


# -- k-means: the Lloyd step written out, frozen per image once it has converged ------------------
def _lloyd(ranges: list[tuple[int, int]] | str, steps: int = fixed.KMEANS_MAX_ITER) -> list[str]:
    """From ranges that all images share, or from the name of a table of them."""
    if isinstance(ranges, str):
        start = f"(SELECT image_id, cluster, (lo + hi) / 2::DOUBLE AS centroid FROM {ranges})"
    else:
        rows = ", ".join(f"({i}, {(lo + hi) / 2.0}::DOUBLE)" for i, (lo, hi) in enumerate(ranges))
        start = f"(SELECT DISTINCT image_id FROM hist) CROSS JOIN (VALUES {rows}) AS s(cluster, centroid)"
    parts = [f"c0 AS MATERIALIZED (SELECT image_id, cluster, centroid, false AS done, 0 AS it FROM {start})"]
    for i in range(1, steps + 1):
        parts.append(
            f"""c{i} AS MATERIALIZED (
  SELECT image_id, cluster, CASE WHEN done THEN old ELSE moved END AS centroid,
         done OR max(abs(moved - old)) OVER (PARTITION BY image_id) < {fixed.KMEANS_SHIFT} AS done,
         it + CASE WHEN done THEN 0 ELSE 1 END AS it
  FROM (SELECT c.image_id, c.cluster, c.done, c.it, c.centroid AS old, coalesce(m.mean, c.centroid) AS moved
        FROM c{i - 1} c LEFT JOIN (
          SELECT image_id, cluster, sum(n * v)::DOUBLE / sum(n)::DOUBLE AS mean
          FROM (SELECT h.image_id, h.v, h.n, c.cluster,
                       row_number() OVER (PARTITION BY h.image_id, h.v
                                          ORDER BY abs(h.v - c.centroid), c.cluster) AS rn
                FROM hist h JOIN c{i - 1} c ON c.image_id = h.image_id)
          WHERE rn = 1 GROUP BY 1, 2) m ON m.image_id = c.image_id AND m.cluster = c.cluster))"""
        )
    parts.append(
        f"""fin AS MATERIALIZED (
  SELECT image_id, CAST(row_number() OVER w - 1 AS INT) AS cluster, centroid, it, done,
         lag(centroid) OVER w AS prev, lead(centroid) OVER w AS next
  FROM c{steps} WINDOW w AS (PARTITION BY image_id ORDER BY centroid, cluster))"""
    )
    parts.append(
        """km AS MATERIALIZED (
  SELECT image_id, cluster, CAST(CASE WHEN prev IS NULL THEN 0 ELSE floor((prev + centroid) / 2) + 1 END AS INT) AS lo,
         CAST(CASE WHEN next IS NULL THEN 255 ELSE floor((centroid + next) / 2) END AS INT) AS hi
  FROM fin)"""
    )
    return parts


def _kmeans(select: str, ranges: list[tuple[int, int]] | None = None) -> str:
    return _with(R1, HIST, *_lloyd(ranges or EQUAL[6]), select)


# -- classification -------------------------------------------------------------------------------
def _dims(k: int) -> str:
    rows = ", ".join(
        f"({i}, {lo}, {hi}, {_text(name)}, {r}, {g}, {b})"
        for i, ((lo, hi), name, (r, g, b)) in enumerate(zip(*DIMS[k]))
    )
    return f"dims AS (SELECT * FROM (VALUES {rows}) AS d(cluster, lo, hi, name, r, g, b))"


TOTALS = "totals AS (SELECT image_id, sum(n)::BIGINT AS total FROM hist GROUP BY 1)"


def _counted(ranges: str, on: str = "true") -> str:
    return f"""counted AS (
  SELECT t.image_id, d.cluster, d.lo, d.hi, coalesce(sum(h.n), 0)::BIGINT AS n, any_value(t.total) AS total
  FROM totals t JOIN {ranges} d ON {on}
  LEFT JOIN hist h ON h.image_id = t.image_id AND h.v BETWEEN d.lo AND d.hi GROUP BY 1, 2, 3, 4)"""


EDITED = """edits AS (
  SELECT image_id, image_id % 4 + 1 AS cluster, image_id % 2 = 0 AS upper_bound, 60 + (image_id * 17) % 150 AS value
  FROM totals),
edited AS MATERIALIZED (
  SELECT t.image_id, d.cluster,
         CAST(CASE WHEN e.cluster = d.cluster AND NOT e.upper_bound THEN e.value
              WHEN e.cluster = d.cluster - 1 AND e.upper_bound THEN least(255, e.value + 1) ELSE d.lo END AS INT) AS lo,
         CAST(CASE WHEN e.cluster = d.cluster AND e.upper_bound THEN e.value
              WHEN e.cluster = d.cluster + 1 AND NOT e.upper_bound THEN greatest(0, e.value - 1) ELSE d.hi END AS INT) AS hi
  FROM totals t CROSS JOIN dims d JOIN edits e ON e.image_id = t.image_id)"""

# the binary number, rounded once
_SHOWN = "format('{:.1f}', c.n::DOUBLE / c.total * 100)"
_LEGEND = (
    f"SELECT c.image_id, c.cluster, d.name, c.n, c.n::DOUBLE / c.total * 100 AS share, CAST({_SHOWN} AS DOUBLE) AS percent,"
    f" concat(d.name, '-', {_SHOWN}, '%') AS text, d.r, d.g, d.b FROM counted c JOIN dims d ON d.cluster = c.cluster"
)
_COUNTS = (
    f"SELECT image_id, cluster, lo, hi, n, n::DOUBLE / total * 100 AS share, CAST({_SHOWN} AS DOUBLE) AS percent,"
    " lo > hi AS invalid FROM counted c"
)


def _recolour(ranges: str, on: str) -> str:
    return (
        "SELECT p.image_id, p.y, p.x, coalesce(d.b, 0) AS b, coalesce(d.g, 0) AS g, coalesce(d.r, 0) AS r"
        f" FROM (SELECT r1.image_id, r1.y, r1.x, max(e.cluster) AS cluster FROM r1 LEFT JOIN {ranges} e"
        f" ON {on} AND r1.v BETWEEN e.lo AND e.hi GROUP BY 1, 2, 3) p LEFT JOIN dims d ON d.cluster = p.cluster"
    )


# -- histograms -----------------------------------------------------------------------------------
def _full_hist(source: str, bands: dict[str, str]) -> str:
    union = " UNION ALL ".join(f"SELECT image_id, '{band}' AS band, {e} AS v FROM {source}" for band, e in bands.items())
    return f"""vals AS MATERIALIZED ({union}),
full_hist AS MATERIALIZED (
  SELECT s.image_id, s.band, CAST(l.v AS INT) AS v, coalesce(c.n, 0)::BIGINT AS n
  FROM (SELECT DISTINCT image_id, band FROM vals) s CROSS JOIN range(256) AS l(v)
  LEFT JOIN (SELECT image_id, band, v, count(*) AS n FROM vals GROUP BY 1, 2, 3) c
    ON c.image_id = s.image_id AND c.band = s.band AND c.v = l.v)"""


def _rebinned(bins: int, density: bool = False, cumulative: bool = False, radius: int = 0) -> str:
    width = f"(256::DOUBLE / {bins})"
    mass = "mass"
    if density:
        mass = f"mass / (sum(mass) OVER (PARTITION BY image_id, band) * {width})"
    elif not cumulative:
        mass = f"mass / {width}"
    parts = f"""spread AS (
  SELECT image_id, band, bin, sum(n * (least(v + 1, (bin + 1) * 256::DOUBLE / {bins}) - greatest(v, bin * 256::DOUBLE / {bins}))) AS mass
  FROM full_hist JOIN (SELECT CAST(i AS INT) AS bin FROM range({bins}) AS t(i)) b
    ON v + 1 > bin * 256::DOUBLE / {bins} AND v < (bin + 1) * 256::DOUBLE / {bins} GROUP BY 1, 2, 3),
scaled AS (SELECT image_id, band, bin, {mass} AS mass FROM spread)"""
    out = "scaled"
    if cumulative:
        parts += """,
running AS (SELECT image_id, band, bin, sum(mass) OVER (PARTITION BY image_id, band ORDER BY bin) AS mass FROM scaled)"""
        out = "running"
    if radius:
        parts += f""",
smooth AS (
  SELECT s.image_id, s.band, s.bin, sum(o.mass) / {2 * radius + 1} AS mass
  FROM {out} s CROSS JOIN range(-{radius}, {radius + 1}) AS k(k)
  JOIN {out} o ON o.image_id = s.image_id AND o.band = s.band AND o.bin = least({bins - 1}, greatest(0, s.bin + k))
  GROUP BY 1, 2, 3)"""
        out = "smooth"
    return f"""{parts}
SELECT image_id, band, bin, round(bin * 256::DOUBLE / {bins}, 9) AS lo, round((bin + 1) * 256::DOUBLE / {bins}, 9) AS hi,
       round(mass, {14 if density else 6}) AS mass FROM {out}"""


GRAY = {"gray": "v"}
RGB = {"red": "r", "green": "g", "blue": "b"}


def _plot(source: str, fixture: str, bands: dict[str, str], *args, **kw) -> str:
    return f"WITH {fixture},\n{_full_hist(source, bands)},\n{_rebinned(*args, **kw)}"


# -- neighbourhoods -------------------------------------------------------------------------------
def _mirror(i: str, n: int) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * ({n} - 1) - ({i}) ELSE {i} END"


def _box(source: str, values: list[str], radius: int, extra: str = "") -> str:
    sums = ", ".join(f"sum(o.{v})::BIGINT AS {v}" for v in values)
    group = "p.image_id, p.y, p.x" + (f", p.{extra}" if extra else "")
    return f"""box AS (
  SELECT {group}, {sums}
  FROM {source} p CROSS JOIN range(-{radius}, {radius + 1}) AS i(dy) CROSS JOIN range(-{radius}, {radius + 1}) AS j(dx)
  JOIN {source} o ON o.image_id = p.image_id AND o.y = {_mirror('p.y + dy', HEIGHT)} AND o.x = {_mirror('p.x + dx', WIDTH)}
  GROUP BY {group})"""


def _fold(i: str, n: int) -> str:
    """Mirrored position, however far outside."""
    turn = f"((({i}) % {2 * (n - 1)}) + {2 * (n - 1)}) % {2 * (n - 1)}"
    return f"least({turn}, {2 * (n - 1)} - ({turn}))"


def _two_passes(source: str, radius: int) -> list[str]:
    around = f"range(-{radius}, {radius + 1}) AS i(d)"
    return [
        f"wide AS MATERIALIZED (SELECT p.image_id, p.y, p.x, sum(o.v)::BIGINT AS s FROM {source} p CROSS JOIN {around}"
        f" JOIN {source} o ON o.image_id = p.image_id AND o.y = p.y AND o.x = {_fold('p.x + d', WIDTH)} GROUP BY ALL)",
        f"tall AS (SELECT p.image_id, p.y, p.x, sum(o.s)::BIGINT AS s FROM {source} p CROSS JOIN {around}"
        f" JOIN wide o ON o.image_id = p.image_id AND o.x = p.x AND o.y = {_fold('p.y + d', HEIGHT)} GROUP BY ALL)",
    ]


def _weighted(source: str, radius: int) -> list[str]:
    """The same for windows wider than the image: how often each window shows each row and column."""
    shown = lambda length: f"SELECT t.i AS place, {_fold('t.i + d', length)} AS seen, count(*) AS c FROM range({length}) AS t(i) CROSS JOIN range(-{radius}, {radius + 1}) AS r(d) GROUP BY ALL"
    return [
        f"across AS MATERIALIZED ({shown(WIDTH)})",
        f"down AS MATERIALIZED ({shown(HEIGHT)})",
        f"wide AS MATERIALIZED (SELECT image_id, y, place AS x, sum(c * v)::BIGINT AS s FROM {source} JOIN across ON seen = x GROUP BY ALL)",
        "tall AS (SELECT image_id, place AS y, x, sum(c * s)::BIGINT AS s FROM wide JOIN down ON seen = y GROUP BY ALL)",
    ]


# -- clicks ---------------------------------------------------------------------------------------
PAIRS = f"""inside AS (SELECT * FROM e1 WHERE x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1}
  AND image_id IN (SELECT vec_id // 100 FROM embeddings)),
turned AS (SELECT *, lag(image_id) OVER u IS DISTINCT FROM image_id AS turn FROM inside
  WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
runs AS (SELECT *, sum(turn::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM turned),
placed AS (SELECT *, row_number() OVER w AS place, lag(x) OVER w AS x1, lag(y) OVER w AS y1 FROM runs
  WINDOW w AS (PARTITION BY user_id, run ORDER BY event_id)),
pairs AS (SELECT user_id, event_id, image_id, x1, y1, x AS x2, y AS y2, unit, ppu,
  sqrt(((x - x1) * (x - x1) + (y - y1) * (y - y1))::DOUBLE) AS distance FROM placed WHERE place % 2 = 0)"""

# -- prompts --------------------------------------------------------------------------------------
PROMPTS = """prompts AS (
  SELECT conv_id, turn, text AS prompt FROM conversations UNION ALL
  SELECT conv_id, turn + 1000, ([{}])[1 + (conv_id * 3 + turn) % {}] FROM conversations)""".format(
    ", ".join(_text(t) for t in TEMPLATES), len(TEMPLATES)
)


def _routed() -> str:
    verbs = " OR ".join(f"starts_with(lower(txt), {_text(v)})" for v in fixed.SCENE_VERBS)
    cut = " ".join(f"WHEN starts_with(lower(txt), {_text(v)}) THEN substr(txt, {len(v) + 1})" for v in fixed.SCENE_VERBS)
    ops = " ".join(f"WHEN contains(lower(txt), {_text(p)}) THEN {_text(o)}" for p, o in fixed.PROMPT_OPERATIONS)
    filler = "|".join(fixed.FILLER_WORDS)
    return f"""stripped AS (SELECT conv_id, turn, prompt, regexp_replace(coalesce(prompt, ''), '^\\s+|\\s+$', '', 'g') AS txt FROM prompts),
parts AS (SELECT *, ({verbs}) AS scene, CASE {ops} END AS op, CASE {cut} END AS rest FROM stripped),
routed AS (
  SELECT conv_id, turn, prompt,
         CASE WHEN scene THEN 'fetch_satellite' WHEN op IS NOT NULL THEN 'process_image' ELSE 'ask_question' END AS intent,
         CASE WHEN scene THEN trim(regexp_replace(regexp_replace(rest, '\\b({filler})\\b', '', 'gi'), '\\s+', ' ', 'g')) END AS location,
         CASE WHEN NOT scene THEN op END AS operation,
         CASE WHEN NOT scene AND op IS NULL THEN txt END AS question
  FROM parts)"""


def _cleaned() -> str:
    answer, heads, steps = "final answer|answer|response", "thinking process|reasoning|analysis|thought process", "step|stage"
    return f"""WITH answers AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 5
    WHEN 1 THEN concat('<think>', text, '</think>', text)
    WHEN 2 THEN concat('Reasoning: ', text, chr(10), 'Final answer: ', text)
    WHEN 3 THEN concat('Step 1 ', text, chr(10), 'Answer: ', text)
    WHEN 4 THEN concat(text, chr(10), chr(10), chr(10), chr(10), text) ELSE text END AS answer
  FROM conversations),
s1 AS (SELECT *, regexp_replace(coalesce(answer, ''), '<think>.*?</think>', '', 'gs') AS t FROM answers),
s2 AS (SELECT * REPLACE (regexp_replace(t, '(?is)^\\s*({heads})\\s*:.*?(\\n\\s*({answer})\\s*:|\\z)', '\\2') AS t) FROM s1),
s3 AS (SELECT * REPLACE (regexp_replace(t, '(?im)^\\s*({answer})\\s*:\\s*', '', 'g') AS t) FROM s2),
s4 AS (SELECT * REPLACE (regexp_replace(t, '(?im)^\\s*({steps})\\s*\\d+[^\\n]*', '', 'g') AS t) FROM s3),
s5 AS (SELECT * REPLACE (regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t) FROM s4)
SELECT conv_id, turn, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS cleaned FROM s5"""


# -- Huffman --------------------------------------------------------------------------------------
# groups of (weight, lowest value, members), kept sorted; each round joins the first two
def _tree(counts: str) -> str:
    return f"""grown AS (
  SELECT image_id, 0 AS round, list_sort(list({{'n': n, 'low': v, 'members': [v]}})) AS g, 0::BIGINT AS bits
  FROM {counts} GROUP BY 1
  UNION ALL
  SELECT image_id, round + 1,
         list_sort(list_append(g[3:], {{'n': g[1].n + g[2].n, 'low': least(g[1].low, g[2].low),
                                        'members': list_concat(g[1].members, g[2].members)}})),
         bits + g[1].n + g[2].n
  FROM grown WHERE len(g) > 1),
single AS (SELECT image_id FROM {counts} GROUP BY 1 HAVING count(*) = 1),
bits AS (SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM single) THEN g[1].n ELSE bits END::BIGINT AS payload_bits
         FROM grown WHERE len(g) = 1),
marks AS (SELECT image_id, round, unnest(g[1].members) AS v, '0' AS bit FROM grown WHERE len(g) > 1
          UNION ALL SELECT image_id, round, unnest(g[2].members), '1' FROM grown WHERE len(g) > 1
          UNION ALL SELECT image_id, 0, v, '0' FROM {counts} WHERE image_id IN (SELECT image_id FROM single)),
codes AS MATERIALIZED (SELECT image_id, CAST(v AS INT) AS v, string_agg(bit, '' ORDER BY round DESC) AS code FROM marks GROUP BY 1, 2)"""


def _huffman(select: str, fixture: str = R1, counts: str = HIST) -> str:
    return f"WITH RECURSIVE {fixture},\n{counts},\n{_tree('hist')}\n{select}"


BYTE_HIST = """hist AS MATERIALIZED (
  SELECT image_id, v, count(*)::BIGINT AS n
  FROM (SELECT image_id, unnest([b, g, r, a]) AS v FROM r2) GROUP BY 1, 2)"""

_HEAD = {"gray": 4 + 4 * fixed.GRAY_FIELDS + 1024, "colour": 4 + 4 * fixed.COLOUR_FIELDS + 1024}


def _sizes(kind: str) -> str:
    return f"""SELECT image_id, sum(n)::BIGINT AS original_bytes, any_value(payload_bits) AS payload_bits,
  CAST(count(*) AS INT) AS unique_values, CAST({_HEAD[kind]} + ceil(any_value(payload_bits) / 8.0) AS BIGINT) AS compressed_bytes
  FROM hist JOIN bits USING (image_id) GROUP BY 1"""


def _audited(kind: str, channels: int) -> str:
    """Container files of which four in five are damaged, as the fixture damages them."""
    magic = fixed.GRAY_MAGIC if kind == "gray" else fixed.COLOUR_MAGIC
    known = "CASE WHEN image_id % 5 = 2 THEN NULL ELSE {} END"
    cells = HEIGHT * WIDTH * channels
    version = known.format("1::BIGINT") if kind == "colour" else "NULL::BIGINT"
    head = _HEAD[kind]
    # a file that is cut at 700 bytes still has its first count entries
    kept = (700 - (head - 1024)) // 4
    counted = (
        f"CASE WHEN image_id % 5 = 1 THEN (SELECT coalesce(sum(n), 0) FROM hist h WHERE h.image_id = bits.image_id AND h.v < {kept})"
        f" WHEN image_id % 5 = 2 THEN NULL ELSE {cells} END::BIGINT"
    )
    whole = f"CAST({head} + ceil(payload_bits / 8.0) AS BIGINT)"
    return f"""SELECT concat('{kind}-image-', image_id) AS path,
  CASE image_id % 5 WHEN 1 THEN 700 WHEN 3 THEN {whole} - 1 ELSE {whole} END::BIGINT AS length,
  {known.format(f"'{magic}'")} AS magic,
  {known.format(f"CASE WHEN image_id % 5 = 4 THEN 0 ELSE {HEIGHT} END::BIGINT")} AS "rows",
  {known.format(f"{WIDTH}::BIGINT")} AS cols, MISSING_CHANNELS AS channels, {known.format("payload_bits")} AS payload_bits,
  {version} AS version, COUNTED AS counted,
  CASE image_id % 5 WHEN 1 THEN 'truncated header' WHEN 2 THEN 'bad magic' WHEN 3 THEN 'payload length differs'
       WHEN 4 THEN 'zero dimensions' END AS problem
  FROM bits""".replace("MISSING_CHANNELS", known.format(f"{channels}::BIGINT")).replace("COUNTED", counted)


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    r1 = lambda select: _with(R1, select)
    r2 = lambda select: _with(R2, select)

    out["px_negative"] = r1("SELECT image_id, y, x, 255 - v AS v FROM r1")
    out["px_brighter"] = r1("SELECT image_id, y, x, greatest(0, least(255, v + 100)) AS v FROM r1")
    out["px_darker"] = r1("SELECT image_id, y, x, greatest(0, least(255, v - 100)) AS v FROM r1")
    out["px_threshold"] = r1("SELECT image_id, y, x, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM r1")
    out["px_grayscale"] = r2(f"SELECT image_id, y, x, {LUMA} AS v FROM r2")
    out["px_color_negative"] = r2("SELECT image_id, y, x, 255 - b AS b, 255 - g AS g, 255 - r AS r, a FROM r2")
    out["px_color_brightness"] = r2(
        "SELECT image_id, y, x, greatest(0, least(255, b + 100)) AS b, greatest(0, least(255, g + 100)) AS g,"
        " greatest(0, least(255, r + 100)) AS r, a FROM r2"
    )
    out["px_color_threshold"] = r2(
        "SELECT image_id, y, x, CASE WHEN b > 127 THEN 255 ELSE 0 END AS b, CASE WHEN g > 127 THEN 255 ELSE 0 END AS g,"
        " CASE WHEN r > 127 THEN 255 ELSE 0 END AS r, a FROM r2"
    )
    out["px_channel_split"] = r2(
        "SELECT image_id, y, x, 'red' AS band, r AS v FROM r2 UNION ALL SELECT image_id, y, x, 'green', g FROM r2"
        f" UNION ALL SELECT image_id, y, x, 'blue', b FROM r2 UNION ALL SELECT image_id, y, x, 'luminance', {LUMA} FROM r2"
    )
    level = lambda c: f"CAST(greatest(0, least(255, floor({c} / 400::DOUBLE * 2.5::DOUBLE * 255::DOUBLE + 0.5::DOUBLE))) AS INT) AS {c}"
    out["px_true_color"] = r2(f"SELECT image_id, y, x, {level('b')}, {level('g')}, {level('r')} FROM r2")
    out["img_statistics"] = r1(
        "SELECT image_id, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean,"
        " round(stddev_pop(v), 6) AS std_dev FROM r1 GROUP BY 1"
    )
    out["img_shape"] = r1(
        "SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width, count(*)::BIGINT AS n_pixels FROM r1 GROUP BY 1"
    )

    out["hist_exact"] = f"WITH {R1},\n{_full_hist('r1', GRAY)}\nSELECT image_id, band, v, n FROM full_hist"
    out["hist_rgb"] = f"WITH {R2},\n{_full_hist('r2', RGB)}\nSELECT image_id, band, v, n FROM full_hist"
    out["hist_rebin_100"] = _plot("r1", R1, GRAY, 100)
    out["hist_density"] = _plot("r1", R1, GRAY, 100, density=True)
    out["hist_cumulative"] = _plot("r1", R1, GRAY, 100, cumulative=True)
    out["hist_density_cumulative"] = _plot("r1", R1, GRAY, 100, density=True, cumulative=True)
    out["hist_smoothed"] = _plot("r2", R2, {"luminance": LUMA}, 64, radius=3)
    out["hist_overlay"] = _plot("r2", R2, RGB, 48, radius=8)

    out["mean_filter_3"] = _with(
        R1, _box("r1", ["v"], 1), "SELECT image_id, y, x, CAST(v // 9 AS INT) AS v FROM box"
    )
    nearest = ", ".join(f"CAST((2 * {c} + 25) // 50 AS INT) AS {c}" for c in ("b", "g", "r"))
    out["mean_filter_color_5"] = _with(
        R2, _box("r2", ["b", "g", "r"], 2, "a"), f"SELECT image_id, y, x, {nearest}, a FROM box"
    )
    out["mean_filter_gray_nearest"] = _with(
        R1, _box("r1", ["v"], 2), "SELECT image_id, y, x, CAST((2 * v + 25) // 50 AS INT) AS v FROM box"
    )
    out["mean_filter_257"] = _with(
        R1, *_two_passes("r1", 128), f"SELECT image_id, y, x, CAST(s // {257 * 257} AS INT) AS v FROM tall"
    )
    out["mean_filter_2049"] = _with(
        R1, *_weighted("r1", 1024), f"SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(s // {2049 * 2049} AS INT) AS v FROM tall"
    )
    sides = [(0, -1), (0, 1), (-1, 0), (1, 0)]
    offsets = ", ".join(f"({dy}, {dx})" for dy, dx in sides)
    out["laplacian"] = r1(
        f"""SELECT p.image_id, p.y, p.x, CAST(least(255, abs(sum(o.v) - 4 * p.v)) AS INT) AS v
  FROM r1 p CROSS JOIN (VALUES {offsets}) AS d(dy, dx)
  JOIN r1 o ON o.image_id = p.image_id AND o.y = {_mirror('p.y + dy', HEIGHT)} AND o.x = {_mirror('p.x + dx', WIDTH)}
  GROUP BY p.image_id, p.y, p.x, p.v"""
    )

    out["kmeans_centroids"] = _kmeans("SELECT image_id, cluster, centroid FROM fin")
    out["kmeans_ranges"] = _kmeans("SELECT image_id, cluster, lo, hi FROM km")
    out["kmeans_runs"] = _kmeans(
        "SELECT image_id, CAST(count(*) AS INT) AS clusters, CAST(any_value(it) AS INT) AS iterations,"
        " any_value(done) AS converged FROM fin GROUP BY 1"
    )
    out["kmeans_counts"] = _kmeans(
        "SELECT km.image_id, km.cluster, coalesce(sum(n), 0)::BIGINT AS n FROM km LEFT JOIN hist"
        " ON hist.image_id = km.image_id AND v BETWEEN lo AND hi GROUP BY 1, 2"
    )
    out["kmeans_labels"] = _kmeans(
        "SELECT r1.image_id, y, x, max(cluster) AS cluster FROM r1 JOIN km ON km.image_id = r1.image_id"
        " AND v BETWEEN lo AND hi GROUP BY 1, 2, 3"
    )
    out["kmeans_nearest_levels"] = _kmeans(
        "SELECT image_id, CAST(l.v AS INT) AS v, cluster FROM fin CROSS JOIN range(256) AS l(v)"
        " QUALIFY row_number() OVER (PARTITION BY image_id, l.v ORDER BY abs(l.v - centroid), cluster) = 1"
    )
    out["kmeans_from_ranges"] = _kmeans("SELECT image_id, cluster, centroid FROM fin", PRESET)
    out["kmeans_from_edited_ranges"] = _with(
        R1, HIST, TOTALS, _dims(6), EDITED, *_lloyd("edited"), "SELECT image_id, cluster, centroid FROM fin"
    )
    out["kmeans_labels_150"] = _with(
        R1, HIST, *_lloyd([(i * 256 // 150, (i + 1) * 256 // 150 - 1) for i in range(150)]),
        "SELECT r1.image_id, y, x, max(cluster) AS cluster FROM r1 JOIN km ON km.image_id = r1.image_id"
        " AND v BETWEEN lo AND hi GROUP BY 1, 2, 3",
    )

    out["classify_counts"] = _with(
        R1, HIST, TOTALS, _dims(6), _counted("dims"),
        _COUNTS,
    )
    out["classify_edit_bounds"] = _with(
        R1, HIST, TOTALS, _dims(6), EDITED, _counted("edited", "d.image_id = t.image_id"),
        _COUNTS,
    )
    out["classify_recolor"] = _with(
        R1, HIST, TOTALS, _dims(6), EDITED, _recolour("edited", "e.image_id = r1.image_id")
    )
    out["classify_recolor_default"] = _with(R1, _dims(9), _recolour("dims", "true"))
    out["land_cover_legend"] = _with(R1, HIST, TOTALS, _dims(6), _counted("dims"), _LEGEND)
    out["land_cover_legend_9"] = _with(R1, HIST, TOTALS, _dims(9), _counted("dims"), _LEGEND)
    out["land_cover_legend_kmeans"] = _with(
        R1, HIST, *_lloyd(EQUAL[6]), TOTALS, _dims(6), _counted("km", "d.image_id = t.image_id"), _LEGEND
    )
    labelled = (
        "lab AS (SELECT r1.image_id, y, x, max(cluster) AS cluster FROM r1 JOIN km ON km.image_id = r1.image_id"
        " AND v BETWEEN lo AND hi GROUP BY 1, 2, 3)"
    )
    out["land_cover_map"] = _with(
        R1, HIST, *_lloyd(EQUAL[6]), _dims(6), labelled,
        "SELECT image_id, y, x, lab.cluster, d.r, d.g, d.b FROM lab JOIN dims d ON d.cluster = lab.cluster",
    )
    out["map_recolor_bgr"] = _with(
        R1, HIST, *_lloyd(EQUAL[7]), _dims(7), labelled,
        "SELECT image_id, y, x, d.b, d.g, d.r FROM lab JOIN dims d ON d.cluster = lab.cluster",
    )
    out["distinct_values"] = _with(
        R1, HIST, "SELECT image_id, 'gray' AS band, count(*)::BIGINT AS unique_values,"
        " string_agg(v::VARCHAR, ',' ORDER BY v) AS levels FROM hist GROUP BY 1",
    )

    out["distance_pairs"] = _with(
        E1, PAIRS, "SELECT user_id, event_id, image_id, x1, y1, x2, y2, distance FROM pairs"
    )
    out["distance_units"] = _with(
        E1, PAIRS,
        "SELECT user_id, event_id, unit, CASE WHEN unit = 'pixels' THEN round(distance, 3)"
        " ELSE round(distance, 3) / ppu::DOUBLE END AS in_unit FROM pairs",
    )
    out["inspect_points"] = _with(
        R1, E1,
        "SELECT event_id, e1.image_id, e1.x, e1.y, CASE WHEN v IS NULL THEN 'x: -, y: -, value: -'"
        " ELSE concat('x: ', e1.x, ', y: ', e1.y, ', value: ', v) END AS text FROM e1 LEFT JOIN r1"
        " ON r1.image_id = e1.image_id AND r1.x = e1.x AND r1.y = e1.y",
    )
    out["inspect_points_color"] = _with(
        R2, E1,
        "SELECT event_id, e1.image_id, e1.x, e1.y, CASE WHEN b IS NULL THEN 'x: -, y: -, value: -'"
        " ELSE concat('x: ', e1.x, ', y: ', e1.y, ', value: BGRA(', b, ', ', g, ', ', r, ', ', a, ')') END AS text"
        " FROM e1 LEFT JOIN r2 ON r2.image_id = e1.image_id AND r2.x = e1.x AND r2.y = e1.y",
    )

    out["inspect_points_coded"] = out["inspect_points"]
    out["inspect_points_coded_color"] = out["inspect_points_color"]
    out["decode_boxes"] = r1(
        "SELECT r1.* FROM r1 JOIN (SELECT image_id, max(y) AS my, max(x) AS mx FROM r1 GROUP BY 1) m USING (image_id)"
        " WHERE y BETWEEN my // 3 AND my // 2 AND x BETWEEN mx // 4 AND mx // 2"
    )

    out["resolve_places"] = _with(
        G1, G2, RESOLVED, "SELECT c_custkey, name, code, lat, lon, code IS NOT NULL AS resolved FROM resolved"
    )
    corners = ", ".join(f"round({c}, 9) AS {c}" for c in ("west", "south", "east", "north"))
    out["place_bboxes"] = _with(
        G1, G2, RESOLVED, _boxed("resolved"), f"SELECT c_custkey, code, {corners} FROM boxed WHERE code IS NOT NULL"
    )
    size = (
        f"CAST(round_even((east - west) * ({fixed.METRES_PER_DEGREE} * cos(radians((south + north) / 2))) / 10, 0) AS INT) AS width,"
        f" CAST(round_even((north - south) * {fixed.METRES_PER_DEGREE} / 10, 0) AS INT) AS height"
    )
    out["scene_requests"] = _with(
        G1, G2, RESOLVED, _boxed("resolved"),
        f"SELECT c_custkey, concat(translate(upper(trim(name)), ' /', '__'), '.png') AS cache_key, {size}, {corners},"
        f" '{fixed.SCENE_COLLECTION}' AS collection, '{fixed.SCENE_FROM}' AS date_from, '{fixed.SCENE_TO}' AS date_to,"
        f" '{fixed.SCENE_ORDER}' AS mosaicking, {_text(fixed.COMPOSITE_SCRIPT)} AS script FROM boxed WHERE code IS NOT NULL",
    )

    def requests(rule: str) -> list[str]:
        key = lambda name: f"concat(translate(upper(trim({name})), ' {rule}', '__'), '.png')"
        return [
            G1, G2, RESOLVED,
            f"asked AS (SELECT {key('name')} AS cache_key, count(*)::BIGINT AS requests FROM resolved"
            " WHERE code IS NOT NULL GROUP BY 1)",
            f"cache AS (SELECT {key('code')} AS cache_key FROM g1 WHERE code IN"
            " (SELECT concat('N-', n_nationkey) FROM nation WHERE n_nationkey < 10))",
        ]

    missing = "SELECT cache_key, requests FROM asked WHERE cache_key NOT IN (SELECT cache_key FROM cache)"
    out["scenes_uncached"] = _with(*requests("/"), missing)
    out["scenes_uncached_dash"] = _with(*requests("-"), missing)
    out["scenes_cached"] = _with(*requests("/"), missing.replace("NOT IN", "IN"))
    out["points_in_sector"] = _with(
        G1, _boxed("g1"),
        """pts AS (SELECT c_custkey, 33 + (c_custkey % 1300) * 0.001::DOUBLE AS plat,
  72.5::DOUBLE + ((c_custkey * 7) % 1000) * 0.001::DOUBLE AS plon FROM customer)""",
        "SELECT c_custkey, code FROM pts JOIN boxed ON plon BETWEEN west AND east AND plat BETWEEN south AND north",
    )
    scenes = (
        "scenes AS (SELECT o_orderkey AS scene_id, concat('N-', o_custkey % 25) AS tile, o_orderdate AS ts,"
        " CAST((o_orderkey * 37) % 101 AS INT) AS cloud_pct FROM orders)"
    )
    out["least_cloud_mosaic"] = _with(
        scenes,
        "SELECT tile, scene_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, cloud_pct FROM scenes"
        " QUALIFY row_number() OVER (PARTITION BY tile ORDER BY cloud_pct, ts DESC, scene_id) = 1",
    )
    out["scene_search"] = _with(
        G1, scenes, _boxed("scenes JOIN g1 ON g1.code = scenes.tile"),
        "SELECT scene_id, tile, cloud_pct FROM boxed WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-01-01'"
        " AND west <= 73.0 AND east >= 72.6 AND south <= 33.9 AND north >= 33.2",
    )

    out["scene_search_collection"] = _with(
        scenes,
        "SELECT scene_id, tile, 'sentinel-2-l2a' AS collection, cloud_pct FROM scenes WHERE scene_id % 3 = 0"
        " AND ts >= TIMESTAMP '1994-06-01' AND ts < TIMESTAMP '1995-06-01'",
    )
    out["route_prompts"] = _with(PROMPTS, _routed(), "SELECT conv_id, turn, intent, location, operation, question FROM routed")
    out["intent_counts"] = _with(
        PROMPTS, _routed(), "SELECT intent, operation, count(*)::BIGINT AS n FROM routed GROUP BY 1, 2"
    )
    out["clean_answers"] = _cleaned()
    sectors = ", ".join(f"({_text(code)}, {lat!r}::DOUBLE, {lon!r}::DOUBLE)" for code, (lat, lon) in fixed.SECTORS.items())
    known = ", ".join(f"({_text(alias)}, {_text(code)})" for alias, code in fixed.ALIASES.items())
    out["prompt_scene_requests"] = _with(
        PROMPTS, _routed(), f"sectors AS (SELECT * FROM (VALUES {sectors}) AS s(code, lat, lon))",
        f"known AS (SELECT alias, sectors.* FROM (VALUES {known}) AS a(alias, code) JOIN sectors USING (code))",
        "placed AS (SELECT conv_id, turn, location AS name, coalesce(s.code, k.code) AS code,"
        " coalesce(s.lat, k.lat) AS lat, coalesce(s.lon, k.lon) AS lon FROM routed LEFT JOIN sectors s"
        " ON s.code = upper(location) LEFT JOIN known k ON k.alias = lower(location) WHERE intent = 'fetch_satellite')",
        _boxed("placed"),
        "SELECT conv_id, turn, name, code, concat(translate(upper(trim(name)), ' /', '__'), '.png') AS cache_key,"
        f" {size} FROM boxed WHERE code IS NOT NULL",
    )

    out["bench_hist_lineitem"] = _with(
        R3,
        "SELECT image_id, band, v, count(*)::BIGINT AS n FROM (SELECT image_id, 'red' AS band, r AS v FROM r3 UNION ALL"
        " SELECT image_id, 'green', g FROM r3 UNION ALL SELECT image_id, 'blue', b FROM r3) GROUP BY 1, 2, 3",
    )
    out["bench_stats_lineitem"] = _with(
        R3,
        f"SELECT image_id, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean,"
        f" round(stddev_pop(v), 6) AS std_dev FROM (SELECT image_id, {LUMA} AS v FROM r3) GROUP BY 1",
    )
    out["distinct_values_lineitem"] = _with(
        R3,
        "SELECT image_id, band, count(DISTINCT v)::BIGINT AS unique_values FROM (SELECT image_id, 'red' AS band, r AS v"
        " FROM r3 UNION ALL SELECT image_id, 'green', g FROM r3 UNION ALL SELECT image_id, 'blue', b FROM r3) GROUP BY 1, 2",
    )

    out["ingest_csv_matrix"] = r1("SELECT image_id, y, x, v FROM r1")
    out["export_csv_matrix"] = r1(
        "SELECT image_id, y, string_agg(v::VARCHAR, ',' ORDER BY x) AS value FROM r1 GROUP BY 1, 2"
    )
    out["ingest_images_gray"] = r1("SELECT image_id, y, x, v FROM r1")
    out["ingest_images_rgb"] = r2("SELECT image_id, y, x, b, g, r, NULL::INT AS a FROM r2")
    out["ingest_images"] = r2("SELECT image_id, y, x, b, g, r, a FROM r2")
    out["ingest_runs"] = r1(
        "SELECT image_id::VARCHAR AS run, unnest(['operation', 'rows', 'cols', 'note']) AS key,"
        " unnest(['meanfilter', (max(y) + 1)::VARCHAR, (max(x) + 1)::VARCHAR, 'a=b']) AS value FROM r1 GROUP BY image_id"
    )
    out["ingest_centroids"] = _kmeans(
        "SELECT image_id::VARCHAR AS run, cluster, CAST(floor(centroid + 0.5::DOUBLE) AS INT) AS centroid FROM fin"
    )
    rounded = "CAST(floor(centroid + 0.5::DOUBLE) AS INT)"
    out["centroid_drift"] = _kmeans(
        f"SELECT fin.image_id, fin.cluster, e.stored, {rounded} AS fresh, {rounded} - e.stored AS drift FROM fin JOIN"
        f" (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY centroid, cluster) - 1 AS cluster,"
        f" {rounded} AS stored FROM c3) e ON e.image_id = fin.image_id AND e.cluster = fin.cluster"
    )
    out["ingest_ranges"] = _kmeans("SELECT image_id::VARCHAR AS run, cluster, lo, hi FROM km")
    out["parse_range_strings"] = _kmeans("SELECT image_id, cluster, lo, hi FROM km")
    out["gazetteer_load"] = _with(
        G1, "SELECT a.alias, upper(g1.code) AS code, g1.lat, g1.lon FROM g1 JOIN g1 a ON a.code = g1.code"
    )
    out["read_saved_box"] = r1("SELECT * FROM r1 WHERE image_id = 3 AND y BETWEEN 5 AND 17 AND x BETWEEN 11 AND 30")
    out["save_result"] = _with(R1, HIST, "SELECT image_id, 'gray' AS band, v, n FROM hist")

    chain = (
        R1,
        "neg AS (SELECT image_id, y, x, 255 - v AS v FROM r1)",
        _box("neg", ["v"], 1),
    )
    out["operation_chain"] = _with(
        *chain, "SELECT image_id, y, x, CASE WHEN v // 9 > 127 THEN 255 ELSE 0 END AS v FROM box"
    )
    notes = [("negative", {}), ("meanfilter", {"window": 3}), ("threshold", {"value": 127})]
    rows = ", ".join(
        f"({i}, '{name}', '{key}', '{value}')"
        for i, (name, extra) in enumerate(notes)
        for key, value in {"operation": name, "rows": HEIGHT, "cols": WIDTH, **extra}.items()
    )
    out["operation_chain_metadata"] = r1(
        "SELECT image_id, step, operation, key, value FROM (SELECT DISTINCT image_id FROM r1)"
        f" CROSS JOIN (VALUES {rows}) AS m(step, operation, key, value)"
    )

    out["chain_kmeans"] = _kmeans(
        "SELECT r1.image_id, y, x, max(cluster) AS v FROM r1 JOIN km ON km.image_id = r1.image_id"
        " AND v BETWEEN lo AND hi GROUP BY 1, 2, 3"
    )
    out["chain_laplacian"] = out["laplacian"]  # the sign goes, so the negative has the same edges
    out["chain_gray_brightness"] = r2(f"SELECT image_id, y, x, greatest(0, least(255, {LUMA} + 40)) AS v FROM r2")
    out["chain_statistics"] = r1(
        "SELECT image_id, 255 - max(v) AS min_value, 255 - min(v) AS max_value, round(avg(255 - v), 6) AS mean,"
        " round(stddev_pop(v), 6) AS std_dev FROM r1 GROUP BY 1"
    )
    changed = [(2, "255 - v"), (4, "least(255, 315 - v)"), (6, "CASE WHEN least(255, 315 - v) > 200 THEN 255 ELSE 0 END")]
    out["chain_counted"] = r1(
        "SELECT image_id, min_value, max_value, mean, std_dev, step, last_levels FROM ("
        + " UNION ALL ".join(
            f"SELECT image_id, min({v}) AS min_value, max({v}) AS max_value, round(avg({v}), 6) AS mean,"
            f" round(stddev_pop({v}), 6) AS std_dev, {step} AS step FROM r1 GROUP BY 1"
            for step, v in changed
        )
        + f") JOIN (SELECT image_id, CAST(count(DISTINCT {changed[-1][1]}) AS INTEGER) AS last_levels FROM r1 GROUP BY 1) USING (image_id)"
    )
    out["chain_histogram"] = out["hist_rebin_100"]
    out["chain_distance"] = _with(
        E1, PAIRS,
        "SELECT image_id, 0 AS step, 'distance' AS operation, unnest(['operation', 'x1', 'y1', 'x2', 'y2', 'distance']) AS key,"
        " unnest(['distance', x1::VARCHAR, y1::VARCHAR, x2::VARCHAR, y2::VARCHAR, printf('%.3f', distance)]) AS value FROM pairs",
    )
    out["chain_compress"] = _huffman(
        f"""SELECT image_id, 0 AS step, 'huffman_compress' AS operation,
  unnest(['operation', 'rows', 'cols', 'original_bytes', 'compressed_bytes', 'payload_bits', 'unique_values']) AS key,
  unnest(['huffman_compress', '{HEIGHT}', '{WIDTH}', sum(n)::VARCHAR,
          CAST({_HEAD['gray']} + ceil(any_value(payload_bits) / 8.0) AS BIGINT)::VARCHAR, any_value(payload_bits)::VARCHAR,
          count(*)::VARCHAR]) AS value
  FROM hist JOIN bits USING (image_id) GROUP BY image_id"""
    )
    out["chain_decompress"] = r1("SELECT image_id, y, x, v FROM r1")
    out["chain_prompts"] = _with(*chain, "SELECT image_id, y, x, CAST(v // 9 AS INT) AS v FROM box")

    out["huffman_codes"] = _huffman(
        "SELECT image_id, v, n, code, CAST(length(code) AS INT) AS code_len FROM codes JOIN hist USING (image_id, v)"
    )
    out["huffman_sizes"] = _huffman(_sizes("gray"))
    out["huffman_sizes_color"] = _huffman(_sizes("colour"), R2, BYTE_HIST)
    out["huffman_segments"] = _huffman(
        """, segs AS (
  SELECT image_id, (y * 64 + x) // 1000 AS seg, count(*) AS n_values, string_agg(code, '' ORDER BY y, x) AS bits
  FROM r1 JOIN codes USING (image_id, v) GROUP BY 1, 2),
padded AS (SELECT *, rpad(bits, CAST(ceil(length(bits) / 8.0) * 8 AS INT), '0') AS whole FROM segs)
SELECT image_id, seg::BIGINT AS seg, CAST(n_values AS INT) AS n_values, CAST(length(bits) AS INT) AS payload_bits,
       array_to_string(list_transform(range(0, length(whole) // 4), lambda i: substr('0123456789ABCDEF', CAST(1
         + 8 * substr(whole, 4 * i + 1, 1)::INT + 4 * substr(whole, 4 * i + 2, 1)::INT
         + 2 * substr(whole, 4 * i + 3, 1)::INT + substr(whole, 4 * i + 4, 1)::INT AS BIGINT), 1)), '') AS payload
FROM padded"""
    )
    out["huffman_roundtrip"] = r1("SELECT image_id, y, x, v FROM r1")
    out["huffman_roundtrip_color"] = r2("SELECT image_id, y, x, b, g, r, a FROM r2")
    out["huffman_roundtrip_rgb"] = r2("SELECT image_id, y, x, b, g, r, NULL::INT AS a FROM r2")
    out["huffman_roundtrip_mixed"] = r2(
        "SELECT image_id, y, x, b, g, r, CASE WHEN image_id % 2 = 1 THEN a END AS a FROM r2"
    )
    out["huffman_lossless"] = "SELECT 0::BIGINT AS differing"
    out["huffman_audit"] = _huffman(
        f"""SELECT concat('image-', image_id) AS path, CAST({_HEAD['gray']} + ceil(payload_bits / 8.0) AS BIGINT) AS length,
  '{fixed.GRAY_MAGIC}' AS magic, {HEIGHT}::BIGINT AS "rows", {WIDTH}::BIGINT AS cols, 1::BIGINT AS channels, payload_bits,
  NULL::BIGINT AS version, {HEIGHT * WIDTH}::BIGINT AS counted, NULL::VARCHAR AS problem
  FROM bits"""
    )
    gray = _audited("gray", 1)
    colour = _audited("colour", 4)
    out["huffman_audit_files"] = (
        f"SELECT * FROM ({_huffman(gray)}) UNION ALL SELECT * FROM ({_huffman(colour, R2, BYTE_HIST)})"
    )
    return out
