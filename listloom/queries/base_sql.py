"""Plain SQL on the catalogue that says what every shop page must yield.

``{items}`` is the start of a query: one row per part with the expected fields.
No page, parser or rule is involved.
"""

from __future__ import annotations

from listloom.queries.expected import EXPECTED_ALIASES, EXPECTED_HOSTS, EXPECTED_SIZES

SITE_LIST = (
    "['Zappos', 'Vans', 'Lacoste', 'Adidas', 'Asics', 'North Face Korea', 'North Face Youngone', 'Abc Grand Stage']"
)


def values(rows) -> str:
    def cell(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


ALIASES = f"alias(ko_name, site_official) AS ({values(EXPECTED_ALIASES)})"
HOSTS = f"host_of(site_official, host) AS ({values(EXPECTED_HOSTS)})"
SIZE_MAP = f"size_map(grp, us_key, us_num, mm) AS ({values(EXPECTED_SIZES)})"

#: Size text of a quantity column ``q``.
US = "CASE WHEN q % 2 = 0 THEN CAST(CAST(q / 2 AS BIGINT) AS VARCHAR) ELSE CAST(q / 2 AS VARCHAR) END"

STOCK = """sz AS (
    SELECT l_partkey, l_quantity AS q, CAST(l_quantity AS BIGINT) AS iq, bool_or(l_linestatus = 'O') AS ok
    FROM lineitem GROUP BY 1, 2
)"""

ITEMS = f"""
{HOSTS}, {STOCK}, item AS (
    SELECT p.*, p_partkey % 8 AS k, p_partkey // 8 AS c,
        {SITE_LIST}[p_partkey % 8 + 1] AS site,
        (p_partkey // 8) % 5 <> 4 AS described,
        CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS usd,
        CAST(CAST(p_retailprice - 10 AS DECIMAL(12,2)) AS VARCHAR) AS usd_sale,
        CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS won,
        CAST(p_size AS VARCHAR) AS size_no, CAST(p_partkey AS VARCHAR) AS p,
        list_transform(range(1, least(3, 9 - p_partkey % 10) + 1), lambda i: p_partkey + i) AS links
    FROM part p
), sized AS (
    -- The sizes a page offers, in stock only, as shown there.
    SELECT p_partkey, q AS ord, CASE
            WHEN k = 4 AND c % 4 = 3 AND q BETWEEN 14 AND 27 THEN 'K' || {US}
            WHEN k IN (5, 6) AND c % 4 = 3 THEN '여성' || iq
            WHEN k IN (5, 6, 7) THEN CAST(iq * 5 AS VARCHAR)
            ELSE {US} END AS size
    FROM item JOIN sz ON l_partkey = p_partkey
    WHERE k <> 1 AND (ok OR (k IN (5, 6) AND c % 3 = 0 AND q = (SELECT min(q) FROM sz s WHERE s.l_partkey = p_partkey)))
    UNION ALL
    SELECT p_partkey, 999, '9D' FROM item WHERE k = 0 AND c % 10 = 3
), size_list AS (
    SELECT p_partkey, string_agg(size, ',' ORDER BY ord) AS sizes, count(*) AS n_sizes FROM sized GROUP BY 1
), kinds AS (
    SELECT p_partkey, CASE WHEN k IN (0, 4) THEN ['women', 'men', 'unisex', 'kids'][c % 4 + 1] ELSE '' END AS audience,
        CASE WHEN k IN (0, 4) THEN [2, 1, 1, 3][c % 4 + 1] ELSE 1 END AS size_type,
        CASE WHEN k IN (0, 4) AND c % 4 = 3 THEN CASE k WHEN 0 THEN 'kids' ELSE 'kids_with_front_k' END
             WHEN k IN (0, 4) AND c % 4 = 0 THEN 'womens' ELSE 'mens' END AS grp
    FROM item
), {SIZE_MAP}, converted AS (
    SELECT s.p_partkey, s.ord, CAST(m.mm AS VARCHAR) AS size
    FROM sized s JOIN item i USING (p_partkey) JOIN kinds g USING (p_partkey)
    JOIN size_map m ON m.grp = g.grp AND CASE g.grp WHEN 'kids_with_front_k' THEN m.us_key = s.size
        ELSE m.us_num = TRY_CAST(s.size AS DOUBLE) END
    WHERE i.k IN (0, 2, 3, 4) AND NOT (i.k = 0 AND i.c % 10 = 3)
    UNION ALL
    SELECT s.p_partkey, s.ord, s.size FROM sized s JOIN item i USING (p_partkey)
    WHERE i.k NOT IN (0, 2, 3, 4) OR (i.k = 0 AND i.c % 10 = 3)
), mm_list AS (
    SELECT p_partkey, string_agg(size, ',' ORDER BY ord) AS sizes, count(*) AS n FROM converted GROUP BY 1
), expected AS (
    SELECT i.*, k.audience, k.size_type, coalesce(s.sizes, '') AS raw_sizes, coalesce(m.sizes, '') AS sizes,
        coalesce(m.n, 0) AS n_sizes,
        coalesce(h.host, '') || '/p/' || p || '.html?color=' || p_partkey % 7 AS url,
        CASE WHEN k = 7 AND c % 6 = 5 THEN '' WHEN k IN (0, 7) THEN p_brand ELSE site END AS brand,
        CASE WHEN k IN (5, 6) THEN '상품 ' || p_name WHEN k = 7 THEN '상품 ' || p_name || ' ' || p_type ELSE p_name END AS name_ko,
        CASE WHEN k = 1 THEN CASE c % 3 WHEN 1 THEN usd_sale ELSE usd END
             WHEN k = 3 AND c % 3 = 0 THEN usd_sale
             WHEN k IN (5, 6) THEN CAST(won AS VARCHAR)
             WHEN k = 7 THEN format('{{:,}}', won) || ' 원' ELSE usd END AS price,
        list_transform(range(1, p_size % 5 + 2), lambda x: CASE k WHEN 0 THEN 'https://img.test/' || p || '-' || x || '._AC_SR800,1500_.jpg'
            WHEN 3 THEN 'https://img.test/w_1400/' || p || '-' || x || '.jpg'
            ELSE 'https://img.test/' || p || '-' || x || '.jpg' END) AS images,
        CASE WHEN (k = 1 AND c % 5 = 3) OR NOT described THEN [] ELSE [p_type] END AS titles,
        CASE WHEN k = 1 AND c % 5 = 3 THEN [p_type] WHEN NOT described THEN []
             WHEN k IN (3, 5, 6, 7) THEN ['size ' || size_no, 'SKU ' || p]
             WHEN k = 4 THEN ['size ' || size_no, 'SKU ' || p || 'tail'] ELSE ['size ' || size_no] END AS bullets,
        CASE WHEN k IN (5, 6) THEN CASE WHEN c % 2 = 0 THEN ['/tech/' || p || '.png', '/size/' || p || '.png']
                ELSE ['/size/' || p || '.png'] END
             WHEN k = 7 THEN ['/detail/' || p || '.png'] ELSE [] END AS details,
        CASE WHEN k = 1 THEN 'Red ' || p ELSE '' END AS color_name,
        CASE k WHEN 1 THEN list_transform(links, lambda l: 'https://www.vans.com/en-us/vn' || l || 'x')
             WHEN 4 THEN list_transform(links, lambda l: 'https://www.asics.com/p/' || l || '.html')
             WHEN 5 THEN list_transform(links, lambda l: 'https://www.thenorthfacekorea.co.kr/p/' || l)
             WHEN 6 THEN list_transform(links, lambda l: 'https://www.youngonestore.co.kr/p/' || l)
             WHEN 7 THEN list_transform(links, lambda l: 'https://grandstage.a-rt.com/product?prdtNo=' || l)
             ELSE [] END AS color_urls
    FROM item i JOIN kinds k USING (p_partkey) LEFT JOIN size_list s USING (p_partkey) LEFT JOIN mm_list m USING (p_partkey)
    LEFT JOIN host_of h ON h.site_official = i.site
)"""


def expecting(select: str) -> str:
    """A query over ``expected``."""
    return f"WITH {ITEMS}\n{select}"


#: The listing body, as SQL over expected fields; {top} … are static image lists.
def body_sql(brand: str, top: str, middle: str, end: str) -> str:
    def tags(items: str, before: str, after: str) -> str:
        return f"array_to_string(list_transform({items}, lambda t: '{before}' || t || '{after}'), '')"

    nl, tab = "' || chr(10) || '", "' || chr(9) || '"
    static = f'" style="max-width: 100%; height: auto;">{nl}{tab}'
    alt = f"""" alt="' || {brand} || '" style="max-width: 100%; height: auto; margin-top: 3mm;">{nl}"""
    para = "<p style=\"font-size: {size}px; font-family: ''Noto Sans''; line-height: {line}%;\"><b>"
    parts = [
        f"'<center style=\"width: 90%; margin: 0 auto;\">{nl}{tab}'",
        tags(top, '<img src="', f'" width="400{static}'),
        f"'{nl}{tab}'",
        tags("images", '<img src="', alt),
        f"'{nl}{tab}<br/>{nl}{tab}<div style=\"display: block;\">{nl}{tab}{tab}'",
        tags(middle, '<img src="', f"{static}{tab}"),
        f"'{nl}{tab}</div>{nl}{tab}<br/>{nl}{tab}'",
        tags("titles", para.format(size=26, line=150), f"</b></p>{nl}"),
        f"'{nl}{tab}<br/>{nl}{tab}'",
        tags("bullets", para.format(size=22, line=120), f"</b></p>{nl}"),
        f"'{tab}{nl}{tab}'",
        tags("details", '<img src="', alt),
        f"'{nl}{tab}'",
        tags(end, '<img src="', static),
        f"'{nl}{tab}</center>{nl}{tab}'",
    ]
    return " || ".join(parts)
