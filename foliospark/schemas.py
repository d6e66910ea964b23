"""Schemas of the engine's tables. Every table carries doc_id and its own order; rows have none."""

UNRESOLVED = "array<struct<idx: int, marker: string>>"
RUNS = f"doc_id long, page int, seq int, text string, x double, y double, font string, size double, unresolved {UNRESOLVED}"
TOKENS = "doc_id long, page int, line_no int, token_no int, x double, text string, width double"
LINES = "doc_id long, page int, line_no int, y double, x double, text string, n_tokens int"
SHAPES = "doc_id long, shape_seq int, type string, page int, x1 double, y1 double, x2 double, y2 double, target string, target_page int, text string, source string"
RECOVERY = "array<struct<seq: int, event: string, page: int, obj: int, gen: int, font: string, n: int, reason: string>>"
ERROR = "struct<code: string, detail: string>"
DOCS = f"doc_id long, path string, version string, page_count int, encrypted boolean, recovery_log {RECOVERY}, error {ERROR}"
IMAGES = "doc_id long, page int, seq int, kind string, bytes binary, x double, y double, width int, height int, render_width double, render_height double, rotation double, ctm array<double>, ref string"
META = "doc_id long, key string, value string, origin string"
ANNOTATIONS = "doc_id long, page int, seq int, type string, x1 double, y1 double, x2 double, y2 double, contents string, title string, subject string, created string, modified string, dest_page int, url string, kind_specific map<string, string>, quad_points array<array<double>>"
OUTLINES = "doc_id long, node_id int, parent_id int, level int, ord int, title string, dest_page int"
FIELDS = "doc_id long, seq int, name string, partial_name string, type string, value struct<kind: string, s: string, b: boolean, arr: array<string>>, default string, tooltip string, flags map<string, boolean>, x1 double, y1 double, x2 double, y2 double"
PAGES = "doc_id long, page int, ref string, width double, height double"
EVENTS = "doc_id long, page int, seq int, kind string, text string, x double, y double, font string, size double, name string, ctm array<double>"
ALL = {"docs": DOCS, "runs": RUNS, "images": IMAGES, "meta": META, "annotations": ANNOTATIONS, "outlines": OUTLINES, "fields": FIELDS, "pages": PAGES, "events": EVENTS}
