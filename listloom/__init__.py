"""Product-page analytics on Spark: raw pages in, marketplace listing rows out.

Everything is a DataFrame operator or a Column expression.  The only Python that
runs per row is the HTML tokeniser in :mod:`listloom.sources.pages`.
"""

from listloom.session import configure, work_dir

__all__ = ["configure", "work_dir"]
