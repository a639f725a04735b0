"""panelwright: keyed panel analytics and forecasting on Spark."""
