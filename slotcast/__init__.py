"""Panel forecasting analytics on PySpark.

A *panel* is one DataFrame holding many 15-minute sales series. A series is the
key ``(location_id, sales_type_id, department_id)``; time is ``ds``; the value is
``y`` (actual) or ``yhat`` (forecast). Every operator maps DataFrames to
DataFrames and works on all series at once.
"""

from slotcast.schemas import KEYS

__all__ = ["KEYS"]
