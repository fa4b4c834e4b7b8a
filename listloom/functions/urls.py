"""URL, image-link and snapshot-key expressions."""

from __future__ import annotations

from listloom.functions.sql import each, q, some
from listloom.functions.text import piece, pieces, remove, squash, swap

# Endpoints and link prefixes of the supported shops.
JSON_ENDPOINT = (
    "https://www.lacoste.com/on/demandware.store/Sites-FlagShip-Site/en_US/"
    "Product-PartialsData?pid=%s&color=%s&full=true"
)
VANS_BASE = "https://www.vans.com/en-us/"
LARGE_IMAGE = "AC_SR800,1500_.jpg"


def is_url(text: str) -> str:
    """Contains ``http`` anywhere; false for null."""
    return f"coalesce(contains({text}, 'http'), false)"


def path_after_host(url: str) -> str:
    """All that follows the third slash, query and fragment included."""
    parts = pieces(url, "/")
    return f"array_join(slice({parts}, 4, greatest(size({parts}) - 3, 0)), '/')"


def last_segment(url: str) -> str:
    return piece(url, "/", -1)


def before(text: str, mark: str) -> str:
    """Text up to the first mark, or all of it."""
    return f"substring_index({text}, {q(mark)}, 1)"


def snapshot_key(site: str, url: str, extension: str = "html", n_hex: int = 6) -> str:
    """``res_{Site}_{hash}.{extension}``.

    Six hex digits are the short name for display; they collide past a few thousand
    pages, so stores are keyed by the whole digest (``sources/snapshots.py``).
    """
    digest = f"substr(sha2(concat({squash(site)}, '_', {path_after_host(url)}), 256), 1, {n_hex})"
    return f"concat('res_', {squash(site)}, '_', {digest}, {q('.' + extension)})"


def _json_url(url: str) -> str:
    """The JSON endpoint of a product URL, null where the URL has no query."""
    tail = last_segment(url)
    product = remove(piece(tail, "?", 0), "'.html'")
    color = remove(piece(tail, "?", 1), "'color='")
    first, middle, last = JSON_ENDPOINT.split("%s")
    return f"concat({q(first)}, {product}, {q(middle)}, {color}, {q(last)})"


def to_json_url(url: str) -> str:
    """JSON endpoint of one product URL; an unusable URL is kept."""
    return f"coalesce({_json_url(url)}, {url})"


def to_json_urls(urls: str) -> str:
    """List form: one unusable URL keeps the whole list unchanged."""
    unusable = some(urls, lambda u: f"{_json_url(u)} IS NULL")
    return f"if({unusable}, {urls}, {each(urls, _json_url)})"


def color_url(color_id: str) -> str:
    return f"concat({q(VANS_BASE)}, lower({color_id}))"


def named_color_url(name: str, color_id: str) -> str:
    slug = swap(f"lower({name})", " ", "-")
    return f"concat({q(VANS_BASE)}, {slug}, '-p', lower({color_id}))"


def large_image(src: str) -> str:
    """Ask the image host for the large rendition; other links are kept."""
    at = f"instr({src}, 'AC_SR')"
    return f"if({at} > 0, concat(substr({src}, 1, {at} - 1), {q(LARGE_IMAGE)}), {src})"


def wide_image(src: str) -> str:
    return swap(src, "w_600", "w_1400")


def full_thumbnail(src: str) -> str:
    return remove(src, "'?thumbnail'")


FILE_NAME = r"^(\.*[^.].*?)(\.[^.]*)?$"


def file_stem(url: str) -> str:
    """File name of a link without query and extension."""
    return f"regexp_extract({before(last_segment(url), '?')}, {q(FILE_NAME)}, 1)"


def file_extension(url: str) -> str:
    """Extension with its dot, or an empty string."""
    return f"regexp_extract({before(last_segment(url), '?')}, {q(FILE_NAME)}, 2)"
