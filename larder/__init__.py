"""larder: Spark-native nutrition, meal-plan and model-evaluation analytics.

Sub-packages:
  sources    - table readers/writers (driver parquet, CSV loads, sinks)
  functions  - reusable Column expressions (text, JSON, vector, date, stats)
  operators  - set-based operators, one function per inventory entry
  plans      - analogue frames over the driver tables and the query registry
  streaming  - Structured Streaming versions of the stateful jobs
"""

__version__ = "0.1.0"
