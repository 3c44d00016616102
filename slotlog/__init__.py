"""Appointment, utilisation and no-show analytics as Spark DataFrame operators."""
