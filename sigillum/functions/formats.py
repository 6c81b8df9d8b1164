"""Text formats that results depend on."""

# A checksum line is 64 lowercase hex digits, two spaces, a name.
DIGEST_HEX_LENGTH = 64
DIGEST_BITS = 256
SEPARATOR = "  "

# Only the start of the line is tested: `.+$` would let `$` match before a
# trailing line separator such as U+2028, and `.` refuse one inside a name.
ENTRY_PATTERN = r"(?s)^[0-9a-f]{64}  ."

# A digest standing alone in text. Java's `\b` counts non-ASCII letters as word
# characters and would miss a digest written directly after a Chinese word, so
# both bounds are spelled out. They follow the digits: tested at every character
# instead, the left one made the scan of ordinary pages take 1.7 times as long.
PUBLISHED_PATTERN = r"([0-9a-f]{64})(?![0-9A-Za-z_])(?<![0-9A-Za-z_][0-9a-f]{64})"

NOT_BLANK_PATTERN = r"\S"
