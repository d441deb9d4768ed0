"""Patterns, markers and names that results depend on."""

#: In order of priority; group 1 is the number.
CHAPTER_PATTERNS = (
    r"(?iuU)(?<!\d)(?:제\s*)?(\d+)\s*(?:화|장)(?!\d)",
    r"(?iuU)第\s*(\d+)\s*[章节話话回]",
    r"(?iuU)\b(?:chương|chuong)\s*(\d+)\b",
    r"(?iuU)\b(?:chapter|chap\.?|ch\.?)\s*#?\s*(\d+)\b",
    r"(?iuU)\b(?:episode|ep\.?)\s*#?\s*(\d+)\b",
)
NOTICE_MARKERS = ("notice", "announcement", "공지", "公告", "通知")
FRONT_MATTER_NAMES = ("cover", "copyright", "contents", "nav", "navigation", "titlepage", "title-page", "toc")
METADATA_MARKERS = ("author:", "tags:", "status:", "synopsis")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg")
SECRET_NAMES = ("key", "api_key", "authorization", "token", "secret")
RETRIABLE_STATUS = (403, 429, 500, 502, 503, 504)
BAD_PAGE_SIGNALS = ("just a moment", "checking your browser", "ddos protection", "attention required", "cloudflare", "404", "not found", "error", "access denied", "forbidden")
ERROR_TITLE_SIGNALS = ("404", "not found", "错误", "不存在")
ERROR_BODY_SIGNALS = ("页面不存在", "页面已删除", "page not found")
CHALLENGE_TITLE_SIGNALS = ("just a moment", "checking your browser", "ddos protection", "attention required", "cloudflare", "wait")
CHALLENGE_BODY_SIGNALS = ("just a moment", "checking your browser", "ddos protection", "cloudflare", "please enable javascript", "please wait", "redirecting")
CHALLENGE_WRAPPERS = ("main-wrapper", "cf-wrapper", "challenge-form")
#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"
#: Tags that break lines in book sections, that are skipped, and that give a title.
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol",
    "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
SKIP_TAGS = frozenset({"head", "script", "style", "svg"})
HEADINGS = ("h1", "h2", "h3", "title")
#: What a page skeleton drops and keeps.
SKELETON_DROP = frozenset({"script", "style", "noscript", "svg", "iframe", "link", "meta"})
SKELETON_ATTRS = ("id", "class", "href", "role", "type", "name")
COVER_ATTRS = ("src", "data-src", "data-original", "data-url", "content", "href")
PROGRESS_LABELS = {"started": "fetching", "fetched": "last", "skipped": "skipped"}
