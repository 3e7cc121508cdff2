"""Declared table schemas; sources read with these instead of inferring."""

WAV_HEADER = "channels int, sample_width int, rate int, datalen bigint, compression_type string"
DEPLOYMENT_CSV = ("recorder string, recorder_group string, begin string, end string, status string, mount string, "
                  "height_above_ground string, longitude string, latitude string")
DEPLOYMENTS = ("recorder string, recorder_group string, begin timestamp, end timestamp, status string, mount string, "
               "height_above_ground double, longitude double, latitude double, elevation_m double, z double")
CATALOG = ("file string, recorder string, recorder_type string, channel string, gps_sync boolean, "
           "start_datetime timestamp, end_datetime timestamp, duration double, latitude double, longitude double, "
           "recorder_group string, timestamp_source string")
WINDOW_SIDECAR = ("file string, abs_start_iso string, win_start double, win_end double, "
                  "embedding array<float>, probs array<struct<class_idx:int,prob:double>>")
CANDIDATES = ("common_name string, birdcode string, call_datetime_r timestamp, call_datetime timestamp, "
              "recorder_group string, call_id string, maxp double, ngoodrecs bigint, ngoodrecs_high bigint, "
              "n_active_recorders bigint")
WEATHER = "dt timestamp, temp_c double, rh double, temp_c_raw double, speed double, source string"
PROFILES = "birdcode string, freqs array<double>, specmean array<double>, specmax array<double>, n_clips bigint"
ERRORS = "call_id string, error_type string, error_msg string"
CLIPS = "call_id string, recorder string, x double, y double, z double, samples array<float>"
GEOJSON = ("type string, features array<struct<properties:struct<name:string>,"
           "geometry:struct<type:string,coordinates:string>>>")
WEATHER_JSON = ("hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>>")
