"""Listing body: image tags, description tags and the page frame around them."""

from __future__ import annotations

from listloom.functions.sql import each, fill

# The markup of a listing body.  {x} marks what is filled in.
TOP_IMAGE = '<img src="{x}" width="400" style="max-width: 100%; height: auto;">\n\t'
MIDDLE_IMAGE = '<img src="{x}" style="max-width: 100%; height: auto;">\n\t\t'
END_IMAGE = '<img src="{x}" style="max-width: 100%; height: auto;">\n\t'
PRODUCT_IMAGE = '<img src="{x}" alt="{brand}" style="max-width: 100%; height: auto; margin-top: 3mm;">\n'
TITLE = "<p style=\"font-size: 26px; font-family: 'Noto Sans'; line-height: 150%;\"><b>{x}</b></p>\n"
BULLET = "<p style=\"font-size: 22px; font-family: 'Noto Sans'; line-height: 120%;\"><b>{x}</b></p>\n"
FRAME = (
    '<center style="width: 90%; margin: 0 auto;">\n'
    "\t{top}\n"
    "\t{product}\n"
    "\t<br/>\n"
    '\t<div style="display: block;">\n'
    "\t\t{middle}\n"
    "\t</div>\n"
    "\t<br/>\n"
    "\t{titles}\n"
    "\t<br/>\n"
    "\t{bullets}\t\n"
    "\t{details}\n"
    "\t{end}\n"
    "\t</center>\n"
    "\t"
)


def tags(items: str, template: str, **parts: str) -> str:
    """One tag per list item, joined; a missing list gives an empty string."""
    filled = each(items, lambda x: fill(template, x=f"coalesce({x}, 'None')", **parts))
    return f"coalesce(array_join({filled}, ''), '')"


def listing_html(
    brand_ko: str, images: str, titles: str, bullets: str, detail_images: str, top: str, middle: str, end: str
) -> str:
    """The listing body in its fixed order of parts."""
    return fill(
        FRAME,
        top=tags(top, TOP_IMAGE),
        product=tags(images, PRODUCT_IMAGE, brand=brand_ko),
        middle=tags(middle, MIDDLE_IMAGE),
        titles=tags(titles, TITLE),
        bullets=tags(bullets, BULLET),
        details=tags(detail_images, PRODUCT_IMAGE, brand=brand_ko),
        end=tags(end, END_IMAGE),
    )
