"""tabloom: table preparation, profiling and analysis operators on Spark DataFrames."""
