"""Explicit schemas of the domain tables and request payloads, and header rename maps."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("invoice_no", T.LongType(), False),
    T.StructField("invoice_date", T.TimestampNTZType(), False),
    T.StructField("quantity", T.DoubleType(), False),
    T.StructField("unit_price", T.DoubleType(), True),
    T.StructField("amount", T.DoubleType(), True),
])

READINGS = T.StructType([
    T.StructField("udi", T.LongType(), False),
    T.StructField("equipment_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("air_temp_k", T.DoubleType(), True),
    T.StructField("process_temp_k", T.DoubleType(), True),
    T.StructField("rpm", T.IntegerType(), True),
    T.StructField("torque_nm", T.DoubleType(), True),
    T.StructField("tool_wear_min", T.IntegerType(), True),
    T.StructField("twf", T.IntegerType(), True),
    T.StructField("hdf", T.IntegerType(), True),
    T.StructField("pwf", T.IntegerType(), True),
    T.StructField("osf", T.IntegerType(), True),
    T.StructField("rnf", T.IntegerType(), True),
    T.StructField("machine_failure", T.IntegerType(), True),
])

# Original sensor CSV headers -> our column names.
SENSOR_HEADER_MAP = {
    "UDI": "udi", "Type": "type", "Air temperature [K]": "air_temp_k",
    "Process temperature [K]": "process_temp_k", "Rotational speed [rpm]": "rpm",
    "Torque [Nm]": "torque_nm", "Tool wear [min]": "tool_wear_min",
    "Machine failure": "machine_failure", "TWF": "twf", "HDF": "hdf", "PWF": "pwf",
    "OSF": "osf", "RNF": "rnf",
}
# Original transaction headers -> our column names.
TRANSACTION_HEADER_MAP = {
    "CustomerID": "customer_id", "InvoiceNo": "invoice_no", "InvoiceDate": "invoice_date",
    "Quantity": "quantity", "UnitPrice": "unit_price", "Amount": "amount",
}

CUSTOMER_REQUEST = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("recency", T.DoubleType(), True),
    T.StructField("frequency", T.DoubleType(), True),
    T.StructField("monetary", T.DoubleType(), True),
    T.StructField("avg_order_value", T.DoubleType(), True),
    T.StructField("total_transactions", T.IntegerType(), True),
    T.StructField("days_since_last_purchase", T.IntegerType(), True),
])

SENSOR_FEATURES = T.StructType([
    T.StructField("air_temperature_k", T.DoubleType(), True),
    T.StructField("process_temperature_k", T.DoubleType(), True),
    T.StructField("rotational_speed_rpm", T.IntegerType(), True),
    T.StructField("torque_nm", T.DoubleType(), True),
    T.StructField("tool_wear_min", T.IntegerType(), True),
    T.StructField("power", T.DoubleType(), True),
    T.StructField("temperature_ratio", T.DoubleType(), True),
    T.StructField("tool_wear_rate", T.DoubleType(), True),
    T.StructField("stress_factor", T.DoubleType(), True),
    T.StructField("type_encoded", T.IntegerType(), True),
])

SENSOR_REQUEST = T.StructType([
    T.StructField("equipment_id", T.StringType(), True),
    T.StructField("features", SENSOR_FEATURES, True),
    T.StructField("threshold", T.DoubleType(), True),
])
