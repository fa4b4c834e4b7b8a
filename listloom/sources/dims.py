"""Fixed dimensions.  All are constants of known, small size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from listloom.functions.sizes import size_rows
from listloom.functions.sql import q, texts

# Korean shop name, official shop name.
SITE_ALIASES = [
    ("자포스", "Zappos"),
    ("휠라", "Fila"),
    ("반스", "Vans"),
    ("라코스테", "Lacoste"),
    ("아디다스", "Adidas"),
    ("크록스", "Crocs"),
    ("노스페이스", "North Face"),
    ("노스페이스 코리아", "North Face Korea"),
    ("노스페이스 영원", "North Face Youngone"),
    ("콜롬비아", "Columbia"),
    ("살로몬", "Salomon"),
    ("아식스", "Asics"),
    ("호카", "Hoka"),
    ("퓨마", "Puma"),
    ("에이비씨 그랜드 스테이지", "Abc Grand Stage"),
    ("리복", "Reebok"),
    ("타미힐피거", "Tommy Hilfiger"),
    ("락포트", "Rockport"),
    ("캘빈클라인", "Calvin Klein"),
    ("게스", "Guess"),
    ("랄프로렌", "Ralph Lauren"),
    ("파타고니아", "Patagonia"),
    ("메이시스", "Macys"),
    ("갭", "Gap"),
    ("갭팩토리", "Gap Factory"),
    ("게스팩토리", "Guess Factory"),
    ("스케쳐스", "Skechers"),
    ("클락스", "Clarks"),
    ("팀버랜드", "Timberland"),
    ("리바이스", "Levis"),
    ("챔피온", "Champion"),
    ("케즈", "Keds"),
    ("알도", "Aldo"),
    ("뉴발란스", "New Balance"),
    ("하바이아나스", "Havaianas"),
    ("테바", "Teva"),
    ("무스조", "Moose Jaw"),
    ("룰루레몬", "Lululemon"),
    ("마시모두띠", "Massimo Dutti"),
    ("카터스", "Carters"),
    ("센스", "Ssense"),
    ("미니로디니", "Mini Rodini"),
    ("피엘라벤", "Fjallraven"),
    ("나이키", "Nike"),
]

# Official shop name, host.
SITE_HOSTS = [
    ("Zappos", "https://www.zappos.com"),
    ("Fila", "https://www.fila.com"),
    ("Vans", "https://www.vans.com"),
    ("Lacoste", "https://www.lacoste.com"),
    ("Adidas", "https://www.adidas.com"),
    ("Crocs", "https://www.crocs.com"),
    ("North Face", "https://www.thenorthface.com"),
    ("North Face Korea", "https://www.thenorthfacekorea.co.kr"),
    ("North Face Youngone", "https://www.youngonestore.co.kr"),
    ("Columbia", "https://www.columbia.com"),
    ("Salomon", "https://www.salomon.com"),
    ("Asics", "https://www.asics.com"),
    ("Hoka", "https://www.hoka.com"),
    ("Puma", "https://us.puma.com"),
    ("Abc Grand Stage", "https://grandstage.a-rt.com"),
    ("Reebok", "https://www.reebok.com"),
    ("Tommy Hilfiger", "https://usa.tommy.com"),
    ("Rockport", "https://www.rockport.com"),
    ("Calvin Klein", "https://www.calvinklein.usr"),
    ("Guess", "https://www.guess.com"),
    ("Ralph Lauren", "https://www.ralphlauren.com"),
    ("Patagonia", "https://www.patagonia.com"),
    ("Macys", "https://www.macys.com"),
    ("Gap", "https://www.gap.com"),
    ("Gap Factory", "https://www.gapfactory.com"),
    ("Guess Factory", "https://www.guessfactory.com"),
    ("Skechers", "https://www.skechers.com"),
    ("Clarks", "https://www.clarks.com"),
    ("Timberland", "https://www.timberland.com"),
    ("Levis", "https://www.levi.com"),
    ("Champion", "https://www.champion.com"),
    ("Keds", "https://www.keds.com"),
    ("Aldo", "https://www.aldoshoes.com"),
    ("New Balance", "https://www.newbalance.com"),
    ("Havaianas", "https://havaianas.com"),
    ("Teva", "https://www.teva.com"),
    ("Moose Jaw", "https://www.moosejaw.com"),
    ("Lululemon", "https://shop.lululemon.com"),
    ("Massimo Dutti", "https://www.massimodutti.com"),
    ("Carters", "https://www.carters.com"),
    ("Ssense", "https://www.ssense.com"),
    ("Mini Rodini", "https://www.minirodini.com"),
    ("Fjallraven", "https://www.fjallraven.com"),
    ("Nike", ""),
]

# Static images of a brand without an entry of its own.
DEFAULT_TOP = ["https://m.media-amazon.com/images/G/01/Zappos/Ralph-Lauren-May-2023/Ralph-Lauren-Mens-MGrid.jpg"]
DEFAULT_MIDDLE = ["https://www.zappos.com/boutiques/3130/poloralphlauren_header110122.gif"]
DEFAULT_END = ["https://shop-phinf.pstatic.net/20231228_296/1703718751132RIyXT_JPEG/sizechartlogo.jpg?type=w860"]

# Country suffixes of official shop names.
COUNTRY_SUFFIXES = ["Korea", "Youngone"]


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table whose size the optimizer knows."""
    fields = T.StructType.fromDDL(schema)
    arrow = pa.Table.from_pylist([dict(zip(fields.names, row)) for row in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(arrow)


def site_alias(spark: SparkSession) -> DataFrame:
    """(ko_name, site_official), 44 rows."""
    return _local(spark, SITE_ALIASES, "ko_name string, site_official string")


def site_host(spark: SparkSession) -> DataFrame:
    """(site_official, host), 44 rows.  One host is mistyped and one empty at the origin."""
    return _local(spark, SITE_HOSTS, "site_official string, host string")


def suspicious_hosts(hosts: DataFrame) -> DataFrame:
    """Data-quality check: hosts that are empty or have no known ending."""
    usable = F.col("host").rlike(r"^https://[^/]+\.(com|co\.kr)$")
    return hosts.where(~usable)


def size_map(spark: SparkSession) -> DataFrame:
    """(size_group, us_key, us_num, mm), 154 rows."""
    return _local(spark, size_rows(), "size_group string, us_key string, us_num double, mm int")


def site_images(spark: SparkSession) -> DataFrame:
    """Static images by brand: every known shop starts with empty lists."""
    rows = [(official, [], [], []) for _, official in SITE_ALIASES]
    return _local(spark, rows, "brand string, top array<string>, middle array<string>, `end` array<string>")


def default_images() -> dict[str, str]:
    """The default image lists as constant arrays."""
    return {"top": texts(DEFAULT_TOP), "middle": texts(DEFAULT_MIDDLE), "end": texts(DEFAULT_END)}


def alias_array() -> str:
    """The alias dimension as one constant array, with the official name squashed and in words."""
    rows = [
        f"named_struct('ko_name', {q(ko)}, 'site_official', {q(official)}, "
        f"'squashed', {q(official.lower().replace(' ', ''))}, 'words', {texts(official.lower().split(' '))})"
        for ko, official in SITE_ALIASES
    ]
    return f"array({', '.join(rows)})"


def host_map() -> str:
    """The host dimension as one constant map."""
    return f"map({', '.join(f'{q(site)}, {q(host)}' for site, host in SITE_HOSTS)})"
