"""veilspark: document pseudonymisation, audit analytics and corpus operators on Spark."""
