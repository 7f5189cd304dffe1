"""Input schemas, the canonical column names and the fixed settings of the analytics."""

from __future__ import annotations

from pyspark.sql import types as T

# Event logs: two files with identical columns.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_date", T.DateType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("space_id", T.StringType()),
        T.StructField("occupancy", T.StringType()),
        T.StructField("arrival_date", T.DateType()),
        T.StructField("arrival_time", T.TimestampNTZType()),
    ]
)

# Space dimension, in file order.  The nested columns stay text; nothing parses them.
SPACE_SCHEMA = T.StructType(
    [
        T.StructField("storey_uuid", T.StringType()),
        T.StructField("dataSource", T.StringType()),
        T.StructField("functionType", T.StringType()),
        T.StructField("interiorSpace", T.BooleanType()),
        T.StructField("sensor_name", T.StringType()),
        T.StructField("room_name", T.StringType()),
        T.StructField("spaceType", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("coordinates", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("storey_floorId", T.LongType()),
        T.StructField("storey_floorPlan", T.StringType()),
        T.StructField("storey_name", T.StringType()),
        T.StructField("storey_geoReference", T.StringType()),
        T.StructField("building_address", T.StringType()),
        T.StructField("building_geo", T.StringType()),
        T.StructField("building_name", T.StringType()),
    ]
)

# Input files of a building data folder; the logs may carry a prefix such as the building's name.
OFFICE_FILE = "*occupancy_sensors_offices.csv"
MEETING_FILE = "*occupancy_sensors_meeting_rooms.csv"
SPACE_FILE = "sensor_space_data_occupancy.csv"

# Words that put a space type into a category.
MEETING_WORDS = ("meeting",)
QUIET_WORDS = ("lab", "library", "focus")
REFRESH_WORDS = ("pantry", "kitchen", "coffee")

# Labels containing one of these are devices, not rooms.
JUNK_WORDS = ("dynet", "sensor")

# Result cap of ad-hoc SQL and the retrieval settings.
ADHOC_ROWS = 500
CHUNK_SIZE = 800
CHUNK_OVERLAP = 80
RETRIEVAL_K = 8
SCORE_GATE = 0.25
MMR_FETCH = 24
MMR_LAMBDA = 0.3
COLLECTION = "spaces-v1"
