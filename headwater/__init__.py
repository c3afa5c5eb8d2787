"""Stream analytics and capacity planning as Spark plans."""
