"""Named, parameterised SQL statements over registered tables."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_PYTHON_TYPES = {"integer": int, "string": str, "float": (int, float), "boolean": bool}


@dataclass(frozen=True)
class Tool:
    name: str
    statement: str
    parameters: dict[str, str] = field(default_factory=dict)
    description: str = ""

    def checked(self, args: dict) -> dict:
        unknown = set(args) - set(self.parameters)
        missing = set(self.parameters) - set(args)
        if unknown or missing:
            raise TypeError(f"{self.name}: unknown {sorted(unknown)}, missing {sorted(missing)}")
        for key, kind in self.parameters.items():
            value = args[key]
            wrong_bool = isinstance(value, bool) and kind != "boolean"
            if wrong_bool or not isinstance(value, _PYTHON_TYPES[kind]):
                raise TypeError(f"{self.name}: {key} must be {kind}")
        return args


class ToolSet:
    """Looks tools up by name and runs them with bound (never spliced) arguments."""

    def __init__(self, tools: list[Tool]):
        self._tools = {t.name: t for t in tools}

    def names(self) -> list[str]:
        return sorted(self._tools)

    def get(self, name: str) -> Tool:
        if name not in self._tools:
            raise KeyError(f"no tool named {name}")
        return self._tools[name]

    def run(self, spark: SparkSession, name: str, tables: dict[str, DataFrame], **args) -> DataFrame:
        tool = self.get(name)
        bound = tool.checked(args)
        # Views of its own for this call: the caller's views, and those of a call at the same time, stay as they are.
        own = {table: f"{table}_{uuid.uuid4().hex}" for table in tables}
        statement = re.sub(r"(?i)\b(from|join)(\s+)(\w+)", lambda m: m[1] + m[2] + own.get(m[3], m[3]), tool.statement)
        try:
            for table, df in tables.items():
                df.createOrReplaceTempView(own[table])
            return spark.sql(statement, args=bound)  # the plan is resolved here, the views are not needed later
        finally:
            for view in own.values():
                spark.catalog.dropTempView(view)


# The search statements of the hotel warehouse.  Unordered or tied results get
# an id as last sort key so that a limit always returns the same rows.
HOTEL_TOOLS = ToolSet([
    Tool(
        "find-hotels-by-price",
        """
        SELECT h.hotel_name, r.room_type_name, p.current_price, p.checkin_date, p.checkout_date
        FROM room_prices p
        JOIN hotels h ON h.hotel_id = p.hotel_id
        JOIN room_types r ON r.room_type_id = p.room_type_id
        WHERE p.current_price <= :max_price AND p.checkin_date = to_date(:checkin_date)
        ORDER BY p.current_price, h.hotel_name, p.booking_id
        LIMIT 50
        """,
        {"max_price": "integer", "checkin_date": "string"},
        "Rooms at or below a price on one day.",
    ),
    Tool(
        "find-hotels-near-attraction",
        """
        SELECT h.hotel_name, n.place_name, n.distance_in_meters, l.full_address
        FROM hotel_nearby_places n
        JOIN hotels h ON h.hotel_id = n.hotel_id
        JOIN hotel_locations l ON l.hotel_id = n.hotel_id
        WHERE n.place_name ILIKE '%' || :attraction_name || '%'
          AND n.distance_in_meters <= :max_distance_meters
        ORDER BY n.distance_in_meters, h.hotel_name, n.place_name
        LIMIT 50
        """,
        {"attraction_name": "string", "max_distance_meters": "integer"},
        "Hotels within a distance of a named place.",
    ),
    Tool(
        "get-hotel-details",
        """
        SELECT hotel_id, hotel_name, description, stars_rating, review_count, popular_facilities,
               property_type, checkin_time_start, checkin_time_end, checkout_time_start, checkout_time_end
        FROM hotels
        WHERE hotel_name ILIKE '%' || :hotel_name_query || '%'
        ORDER BY hotel_id
        LIMIT 5
        """,
        {"hotel_name_query": "string"},
        "Main data of hotels by name.",
    ),
    Tool(
        "get-hotel-facilities",
        """
        SELECT h.hotel_name, f.facility_name
        FROM hotel_facilities f
        JOIN hotels h ON h.hotel_id = f.hotel_id
        WHERE h.hotel_name ILIKE '%' || :hotel_name_query || '%'
        ORDER BY f.facility_name, h.hotel_name
        """,
        {"hotel_name_query": "string"},
        "All facilities of hotels by name.",
    ),
    Tool(
        "get-hotel-reviews",
        """
        SELECT h.hotel_name, r.staff_score, r.facilities_score, r.cleanliness_score, r.comfort_score,
               r.value_for_money_score, r.location_score, r.free_wifi_score, r.average_score
        FROM hotel_reviews r
        JOIN hotels h ON h.hotel_id = r.hotel_id
        WHERE h.hotel_name ILIKE '%' || :hotel_name_query || '%'
        ORDER BY h.hotel_id
        LIMIT 5
        """,
        {"hotel_name_query": "string"},
        "Review scores of hotels by name.",
    ),
])


def escape_like(text: str) -> str:
    """For callers who want ``%`` and ``_`` in a search text taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
