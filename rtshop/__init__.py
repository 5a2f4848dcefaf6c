"""Shop analytics on Spark: daily active devices, change-log routing, order-wide rows and sales search."""
