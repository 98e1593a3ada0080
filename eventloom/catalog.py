"""Every registered query of the library's own operators, with its SQL."""

from eventloom.plans import cases, compared, lifecycle, markup, reports, streamed

FLAGSHIP = "trailing_views"
QUERIES = reports.QUERIES | compared.QUERIES | lifecycle.QUERIES | markup.QUERIES | streamed.QUERIES | cases.QUERIES
ORACLES = reports.ORACLES | compared.ORACLES | lifecycle.ORACLES | markup.ORACLES | streamed.ORACLES | cases.ORACLES
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
