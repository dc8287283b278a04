"""Default configurations: data expectations for the two domain tables.

These are configuration (small dicts read on the driver), not data.
"""

TRANSACTION_EXPECTATIONS = {
    "structure": {
        "required_columns": ["customer_id", "invoice_no", "invoice_date", "quantity",
                             "unit_price", "amount", "currency"],
        "column_types": {"customer_id": "bigint", "invoice_date": "timestamp",
                         "quantity": "int", "amount": "double"},
        "min_rows": 100,
        "max_rows": 50000,
    },
    "constraints": {
        "customer_id": {"not_null": True},
        "invoice_no": {"unique": True},
        "invoice_date": {"not_null": True},
        "quantity": {"min": 1, "max": 45},
        "unit_price": {"min": 1000, "max": 2000},
        "amount": {"min": 0},
    },
    "relationships": [],
}

READING_EXPECTATIONS = {
    "structure": {
        "required_columns": ["udi", "type", "air_temp_k", "process_temp_k", "rpm", "torque_nm",
                             "tool_wear_min", "machine_failure"],
        "column_types": {"udi": "bigint", "rpm": "int", "torque_nm": "double"},
        "min_rows": 1000,
    },
    "constraints": {
        "udi": {"unique": True, "not_null": True},
        "type": {"allowed_values": ["L", "M", "H"]},
        "rpm": {"min": 1200, "max": 1800},
        "tool_wear_min": {"min": 0, "max": 240},
        "torque_nm": {"not_null": True},
        "machine_failure": {"allowed_values": [0, 1]},
    },
    "relationships": [
        {"type": "conditional", "when_column": "twf", "when_value": 1,
         "then_column": "machine_failure", "then_value": 1},
        {"type": "conditional", "when_column": "type", "when_value": "H",
         "then_column": "osf", "then_value": 0},
        {"type": "mutually_exclusive", "column1": "hdf", "column2": "pwf"},
    ],
}
