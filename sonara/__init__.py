"""Speech and transcript analytics on Spark."""
